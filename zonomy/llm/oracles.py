"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


URL_FILTERS = f"""
WITH r(rh, rp, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(act, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM h"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {lower(f"trim(line, {_SPACES})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id"""

_ESCAPES = "len(regexp_extract_all({0}, '<\\\\*/?s>|\\[\\\\*/?INST\\]'))"
CHAT_FORMAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(role) + {_ESCAPES.format("role")} + length(text) + {_ESCAPES.format("text")} + CASE WHEN role = 'assistant' THEN 14 ELSE 13 END) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM o"""

_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format(lower("text"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS.format(lower("text"))}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""

_TOKENS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(lower("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(doc_id, found) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.found)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.found) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_TOKENS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS filled FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
a AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM g GROUP BY doc_id, win HAVING count(*) > 1)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM a) GROUP BY doc_id),
c AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 3 * n_words
  AND 10 * n_dup_lines <= 3 * len(string_split(t, chr(10))) AND 2 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) <= word_chars
  AND 10 * length(regexp_replace(t, '[^!]+', '', 'g')) <= 3 * n_words AND 50 * len(list_distinct(w)) >= n_words AS kept
FROM f"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTS = "list_transform(embedding, lambda x: floor({0} * x::DOUBLE))"
HARD_NEGATIVES = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTS.format(256)} AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3"""

_ASSIGNED = """a{0} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min(((list_dot_product(x, x) - 2 * list_dot_product(x, b) + list_dot_product(b, b))::BIGINT) * 256 + e) AS m FROM r JOIN b{0} USING (p) GROUP BY vec_id, label, p)"""
_MOVED = """b{1} AS MATERIALIZED (SELECT b{0}.p, b{0}.e, coalesce(n.b, b{0}.b) AS b FROM b{0} LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS b FROM (
    SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS c FROM a{0}, range(1, 17) t(i) GROUP BY p, m % 256, i) GROUP BY p, e) n ON n.p = b{0}.p AND n.e = b{0}.e)"""
VECTOR_CODES = f"""
WITH r AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, 16 * p + 1, 16 * p + 16) AS x FROM (SELECT vec_id, label, {_INTS.format(1024)} AS v FROM embeddings WHERE {_FINITE}), range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS b FROM r QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256),
{", ".join(_ASSIGNED.format(k) + ", " + _MOVED.format(k, k + 1) for k in range(4))}, {_ASSIGNED.format(4)},
o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(b, lambda c: c::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o, s"""

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_KINDS = [f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]{20,}"]

_HITS = """SELECT doc_id, {0} AS kind, unnest(string_split_regex(t, '{1}')) AS gap, unnest(list_concat(regexp_extract_all(t, '{1}'), [''])) AS hit, generate_subscripts(string_split_regex(t, '{1}'), 1) AS i FROM d WHERE regexp_matches(t, '{1}')"""
SECRETS = f"""
WITH d AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
h AS ({" UNION ALL ".join(_HITS.format(k, p) for k, p in enumerate(_KINDS))}),
x AS (SELECT doc_id, kind, hit, CASE WHEN kind = 0 THEN regexp_extract(hit, '{_KINDS[0]}', 2) ELSE hit END AS own, (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS s FROM h WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
f AS (SELECT *, s + length(hit) AS e FROM x WHERE length(own) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 20 END),
c AS (SELECT * FROM f WHERE kind < 3 UNION ALL SELECT f.* FROM f WHERE kind = 3 AND len(list_distinct(string_split(own, ''))) >= 10
  AND regexp_matches(own, '[a-z]')::INT + regexp_matches(own, '[A-Z]')::INT + regexp_matches(own, '[0-9]')::INT + regexp_matches(own, '[+/_=-]')::INT >= 3
  AND NOT EXISTS (SELECT 1 FROM f g WHERE g.kind < 3 AND g.doc_id = f.doc_id AND g.s < f.e AND f.s < g.e)),
o AS (SELECT own, count(DISTINCT coalesce(source, chr(0))) > 1 OR count(DISTINCT (coalesce(source, chr(0)), repo)) > 2 AS copied FROM c JOIN d USING (doc_id) GROUP BY own),
k AS (SELECT doc_id, kind, s, copied, concat_ws(':', ['assign', 'access', 'hex', 'owned'][kind + 1], s, e) AS span FROM c JOIN o USING (own) WHERE kind < 3 OR NOT copied),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans, count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (doc_id)"""
