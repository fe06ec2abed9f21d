"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from zonomy.llm import bpe, chat_format, decontaminate, jaccard_join, line_dedup, pitman_yor, quality_gbt, quality_rules, toxicity, url_filters
from zonomy.llm.queries import tokenizer_path
from zonomy.llm.tables import crc_remainder

LINE = "this line is shared by a number of documents, and it is long enough"
LONG = " ".join(f"word{k % 977} and" for k in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "A b C d e f g"), (None, "a b c d e f g"),
        (None, None), (8, f"{LINE}\nown"), (9, f"{LINE.upper()}\n{LINE}"), (10, LINE), (11, f"x\n {LINE}\t"), (12, LINE), (None, LINE)]
CLASH = ["n_lines", "n_dropped", "score", "ids", "n_words", "spans", "kept", "_text", "h", "n", "label", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_line_dedup(docs, nothing, broadcast_keys):
    run = lambda d: line_dedup.line_dedup(d, broadcast_keys=broadcast_keys)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in run(docs).collect()]
    assert len(got) == len(ROWS) and set(run(docs).columns) == set(docs.columns)
    by = {i: (t, n, d) for i, t, n, d in got if i is not None}
    assert by[8] == ("own", 2, 1) and by[9] == ("", 2, 2) and by[10] == ("", 1, 1) and by[11] == ("x", 2, 1) and by[12] == (LINE, 1, 0)
    assert by[1] == ("", 1, 0) and by[2] == ("", 1, 0) and by[3] == (" \n\t ", 2, 0) and by[5][0] == LONG
    assert (None, "", 1, 1) in got
    assert run(nothing).count() == 0


def test_bpe_round_trip(spark, docs, nothing):
    path = tokenizer_path()
    got = bpe.encode(docs, path).withColumn("back", bpe.decode(F.col("ids"), path)).collect()
    assert all(r["back"] == (r["text"] or "") for r in got) and len(got) == len(ROWS)
    assert bpe.encode(nothing, path).count() == 0


def test_chats(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s><\\\\/s> [\\INST]", "<s>", "\\", "", None, "<|endoftext|>é<", "a" * 5000, "[[INST]]\\[/INST]<<s>>"]
    turns = [(c, k, role, text) for c, role in ((1, "assistant"), (2, "user"), (None, "assistant"), (3, None)) for k, text in enumerate(odd)]
    turns += [(4, None, "user", "x"), (4, 0, "assistant", "tie b"), (4, 0, "assistant", "tie a"), (4, 0, "assistant", "tie a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = tokenizer_path()
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(df, path), path).collect()}
    for c in (1, 2, 3, None):
        assert [t["text"] for t in got[c]["turns"]] == [t or "" for t in odd]
        assert "".join(got[c]["loss_texts"]) == ("".join(t or "" for t in odd) if c in (1, None) else "")
        assert got[c]["formatted"].count("<s>") == got[c]["formatted"].count("</s>") == len(odd)
        assert len(got[c]["ids"]) == len(got[c]["loss_mask"])
    assert [t["text"] for t in got[4]["turns"]] == ["x", "tie a", "tie a", "tie b"]
    assert chat_format.format_chats(df.where("false"), path).count() == 0


def test_escapes_are_reversible():
    for text in ("<s>", "<\\s>", "<\\\\/s>", "[INST]<[/INST]", "a<b", "<<s>", "\\<s>\\", "[\\[INST]"):
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text and not any(c in shown for c in chat_format.CONTROLS)


@pytest.mark.parametrize("cascade_keys", [0, 1000])
def test_urls(spark, cascade_keys):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/x/", "allow"), ("b.com", "", "block"), ("b.com", "/ok", "allow"), ("b.com", "/ok", "block"), (None, "/", "block")],
                                  "host string, path string, action string")
    urls = ["http://A.net/x/1", "http://a.net/y", "http://sub.a.net/x/?q#f", "http://anet/x/", "http://net", "http://net/", "http://b.com?x", "http://c.b.com/okay",
            "no scheme", None, "", "x://y://z/#", "http://b.com:80/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(df, rules, cascade_keys=cascade_keys).collect()}
    assert [got[k] for k in range(len(urls))] == [
        ("a.net", "/x/1", "a.net/x/", "allow"), ("a.net", "/y", "net/", "block"), ("sub.a.net", "/x/", "a.net/x/", "allow"), ("anet", "/x/", None, "allow"),
        ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("b.com", "", "b.com", "block"), ("c.b.com", "/okay", "b.com/ok", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("y:", "//z/", None, "allow"), ("b.com:80", "/", None, "allow")]
    assert url_filters.url_filter(df.where("false"), rules, cascade_keys=cascade_keys).count() == 0
    assert url_filters.url_filter(df, rules.where("false"), cascade_keys=cascade_keys).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_near_duplicates(docs, nothing):
    got = rows(jaccard_join.near_duplicates(docs))
    assert got.count((6, 3, 6)) == 2 and (7, 3, 6) in got and (None, 3, 6) in got and (None, 0, None) in got
    assert (1, 0, 1) in got and (3, 0, 3) in got and (4, 1, 4) in got and (10, 10, 8) in got and (12, 10, 8) in got and (None, 10, 8) in got and (9, 14, 9) in got
    assert len(got) == len(ROWS) and jaccard_join.near_duplicates(nothing).count() == 0


def test_contamination(spark, docs, nothing):
    tests = spark.createDataFrame([("t1", "b C, d"), ("t2", "b c d"), ("t3", None), ("t4", "..."), (None, "one"), ("t5", LONG[:3000]), ("t5", LONG[:3000])], "item_id string, text string")
    for block in (1, 5000):
        got = decontaminate.find_contamination(docs, tests, block_items=block)
        by = {r["doc_id"]: r for r in got.collect()}
        assert by[7]["items"] == ["t1", "t2"] and [tuple(s) for s in by[7]["spans"]] == [(1, 4)] and by[7]["n_hit"] == 3 and by[7]["contaminated"]
        assert by[1]["n_words"] == 0 and not by[1]["contaminated"] and by[5]["items"] == ["t5"] and by[4]["n_hit"] == 0
        assert got.count() == len(ROWS) and decontaminate.find_contamination(nothing, tests, block_items=block).count() == 0
    assert decontaminate.find_contamination(docs, tests.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.without_spans("A b, c. D e", [(1, 3)]) == "A . D e"


def test_rules(docs, nothing):
    got = quality_rules.quality_rules(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"] and by[5]["n_words"] == 120_000 and by[5]["n_repeat_words"] == 120_000
    assert by[9]["n_dup_lines"] == 0 and got.count() == len(ROWS) and quality_rules.quality_rules(nothing).count() == 0


def test_language_model(docs, nothing):
    got = pitman_yor.score_texts(docs, crc_remainder("doc_id", 7) != 2)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[1]["score"] == by[2]["score"] < 0
    assert pitman_yor.score_texts(nothing, F.lit(True)).count() == 0
    unknown = pitman_yor.score_texts(docs, F.lit(False)).collect()
    assert all(r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == pytest.approx(0) for r in unknown)


def test_language_model_through_joins(docs):
    """The same scores whether words are looked up in the broadcast head or joined."""
    trains = crc_remainder("doc_id", 7) != 2
    a, b = (rows(pitman_yor.score_texts(docs, trains, head_words=n).select("doc_id", "n_known", F.round("score", 2), F.round("base_score", 6))) for n in (3, 100_000))
    assert a == b


@pytest.mark.parametrize("module, fit, score, label", [(quality_gbt, "fit_quality", "quality_score", "quality"), (toxicity, "fit_toxicity", "toxicity_score", "toxic")])
def test_classifiers(spark, docs, nothing, module, fit, score, label):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(ROWS)] + [(4, None), (99, 1)], f"doc_id long, {label} int")
    for d, y in ((docs, labels), (docs, labels.where("false")), (nothing, labels), (docs, labels.where(f"{label} = 1"))):
        model = getattr(module, fit)(d, y, F.lit(True))
        got = getattr(module, score)(docs, model)
        assert got.where("score between 0 and 1").count() == len(ROWS) and getattr(module, score)(nothing, model).count() == 0
        texts = {r["text"]: r["score"] for r in got.collect()}
        assert texts[None] == texts[""]
