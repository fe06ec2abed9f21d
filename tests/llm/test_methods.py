"""The methods under the operators, each against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from zonomy.llm import bpe, decontaminate, jaccard_join, pitman_yor, quality_gbt, seating, toxicity, url_filters
from zonomy.llm.fm_index import FMIndex
from zonomy.llm.queries import tokenizer_path
from zonomy.llm.seating import Seating
from zonomy.llm.twice import Pair, suspects


def test_fuzzed_bpe():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.encoder(tokenizer_path())
    alphabet = ["a", "the", "ing", "é", "ö", "ß", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'", "'s", "'ll", "<|endoftext|>", "<|", "!", "#", "12", "漢", "😀", "\u0301", "\x1c", "'É", "Qz", "-", "\r\n"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    text = " ".join(["Some words", "\n\n\n and", "x" * 300, "<|endoftext|>", "it's"] * 30)
    ids = np.frombuffer(bpe.Encoder(tokenizer_path()).encode(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_certain_cuts_lie_in_no_token():
    v = bpe.encoder(tokenizer_path()).vocabulary
    assert all(v.inside[a, b] for t in v.tokens.values() for a, b in zip(t, t[1:])) and not v.inside.all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_fm_index(s, phrases):
    index = FMIndex(np.array(s), 3)
    rows = np.zeros((len(phrases), 5), np.int64)
    for k, p in enumerate(phrases):
        rows[k, 5 - len(p):] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == [i for i in range(len(s)) if s[i:i + len(p)] == p]


def test_spans_by_brute_force():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "d"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 6, 9]))).encode()) for k in range(12)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    n, spans, found = decontaminate.search_shard(decontaminate.Phrases.of(items, 5), texts)
    for t, text in enumerate(texts):
        w, hit, own = text.split(), set(), set()
        for name, item in items:
            i = item.split()
            for p in ([i] if 0 < len(i) < 5 else [i[k:k + 5] for k in range(len(i) - 4)]):
                for k in range(len(w) - len(p) + 1):
                    if w[k:k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        own.add(name)
        assert (n[t], {p for a, b in spans[t] for p in range(a, b)}, found[t]) == (len(w), hit, own)


def test_pair_misses_no_repeat():
    rng = np.random.default_rng(1)
    lo = rng.integers(0, 3000, 4000).astype(np.uint64)
    pair = Pair(16)
    for part in np.array_split(lo, 7):
        pair.add(part, part * np.uint64(977))
    values, count = np.unique(lo, return_counts=True)
    held = suspects(pair.again, 16, values, values * np.uint64(977))
    assert held[count > 1].all() and held[count == 1].mean() < 0.1


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).select(F.xxhash64("id").alias("lo"), F.xxhash64("id", F.lit(1)).alias("hi"), "id")
    cascade = url_filters.build_cascade(universe.where("id % 7 = 0"), universe)
    got = universe.orderBy("id").toPandas()
    assert len(cascade.levels) > 1
    assert (cascade.holds(got.lo.values.view(np.uint64), got.hi.values.view(np.uint64)) == (got.id % 7 == 0)).all()


def _near_by_force(texts):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("open_pairs, broadcast_rows", [(8, 300_000), (0, 0)])
def test_near_duplicates(spark, monkeypatch, open_pairs, broadcast_rows):
    monkeypatch.setattr(jaccard_join, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(30)]
    texts, families = [], [[f"f{f}w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 90))] for f in range(12)]
    for i in range(160 if open_pairs else 25):
        words = list(rng.choice(families))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9)}"
        if open_pairs and rng.random() < 0.3:
            words += shared
        texts.append((i, " ".join(words)))
    texts += [(200, ""), (201, "one two"), (202, "One two"), (203, "two one")]
    got = {tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _near_by_force(texts)


def test_first_elements_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    sketch = rng.integers(1, 50, 1 << 12).astype(np.uint32)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64))
        keep = rng.random(len(a)) > 0.12
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, 4).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard_join.first_elements(a, sketch, 80), jaccard_join.first_elements(b, sketch, 80)))


def test_seating_keeps_its_customers():
    rng = np.random.default_rng(4)
    customers = rng.integers(1, 40, 300)
    seats = Seating(customers, np.ones(300, np.int64), np.minimum(customers, 12) + 60)
    seats.sweep(np.full(300, 3.0), 0.5, 12, rng)
    assert (np.add.reduceat(seats.slot, seats.start[:-1]) == customers).all() and (seats.tables <= customers).all() and (seats.tables >= 1).all()
    goal = rng.integers(1, 40, 300)
    seats.shift(goal, np.full(300, 3.0), 0.5, rng)
    assert (np.add.reduceat(seats.slot, seats.start[:-1]) == goal).all() and len(seats.sizes()) == seats.tables.sum()


def test_seating_has_the_right_law():
    """Tables of five customers under Gibbs against all seatings weighed one by one."""
    discount, fresh, n = 0.4, 0.7, 5
    weight = defaultdict(float)
    weight[(1,)] = 1.0
    for _ in range(n - 1):
        more = defaultdict(float)
        for seats, w in weight.items():
            more[tuple(sorted(seats + (1,)))] += w * fresh
            for k, size in enumerate(seats):
                more[tuple(sorted(seats[:k] + (size + 1,) + seats[k + 1:]))] += w * (size - discount)
        weight = more
    law = np.zeros(n + 1)
    for seats, w in weight.items():
        law[len(seats)] += w
    law /= law.sum()
    rng = np.random.default_rng(6)
    sizes, tables = np.full(40_000, n), np.ones(40_000, np.int64)
    for _ in range(6):
        seats = Seating(sizes, tables, np.full(40_000, n))
        seats.sweep(np.full(40_000, fresh), discount, n, rng)
        sizes, tables = seats.sizes(), seats.tables
    assert np.abs(np.bincount(tables, minlength=n + 1) / 40_000 - law).max() < 0.01


def test_table_counts_have_the_right_law():
    """One step gives the law of the seating at once, and cells of any size take as many tables as it asks for."""
    rng = np.random.default_rng(7)
    for discount, fresh in ((0.75, 2.0), (0.6, 30.0)):
        sizes, tables = np.full(1500, 10), np.ones(1500, np.int64)
        for _ in range(12):
            seats = Seating(sizes, tables, np.full(1500, 10))
            seats.sweep(np.full(1500, fresh), discount, 10, rng)
            sizes, tables = seats.sizes(), seats.tables
        got = seating.table_counts(np.full(1500, 10), np.full(1500, fresh), discount, rng)
        assert got.mean() == pytest.approx(tables.mean(), abs=0.2) and got.std() == pytest.approx(tables.std(), abs=0.2)
    # c = f x (1 - x)^(d - 1) customers have f (1 - (1 - x)^d) / d tables in the mean
    f = 100_000 / (0.9 * 0.1 ** -0.25)
    got = seating.table_counts(np.full(2000, 100_000), np.full(2000, f), 0.75, rng)
    assert got.mean() == pytest.approx(f * (1 - 0.1**0.75) / 0.75, rel=1e-3)
    assert seating.table_counts(np.array([0, 1, 2, 10**6]), np.full(4, 1e-9), 0.75, rng).tolist() == [0, 1, 1, 1]


def test_large_cells_near_the_exact_law(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(seating, "EXACT", 700)
    seating._log_weights.cache_clear()
    for fresh in (0.5, 20.0, 200.0, 2000.0):
        c, f = np.full(3000, 700), np.full(3000, fresh)
        exact, near = seating.table_counts(c, f, 0.75, rng), seating._many(c, f, 0.75, rng)
        assert near.mean() == pytest.approx(exact.mean(), rel=0.02, abs=0.1) and near.std() == pytest.approx(exact.std(), rel=0.1)
    seating._log_weights.cache_clear()


def test_a_sweep_reseats_every_customer():
    """A word of 100,000 customers takes more than a fixed number of tables in one sweep."""
    state = {"w": np.array([1, 2], np.uint64), "head": np.array([0, 1]), "a": np.zeros(2, int), "u": np.ones(2, int), "c": np.array([100_000, 3]), "samples": []}
    pitman_yor.seat_block(state, np.full(2, 50_000.0), 50_000.0, np.zeros(pitman_yor.CONTEXTS), 2.0, 2.0, True, 0)
    fresh_root = (pitman_yor.ROOT_STRENGTH + pitman_yor.ROOT_DISCOUNT * 2) / 3
    fresh = (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * 50_000) * (1 - pitman_yor.ROOT_DISCOUNT + fresh_root) / (pitman_yor.ROOT_STRENGTH + 50_000)
    assert fresh / pitman_yor.DISCOUNT > 60 and abs(state["samples"][0][0][0] - fresh / pitman_yor.DISCOUNT) < 6 * (fresh / pitman_yor.DISCOUNT) ** 0.5


def test_probabilities_add_up(spark):
    texts = [(k, " ".join(random.Random(k).choices(["the", "of", "x", "yy", f"rare{k}"], k=40))) for k in range(60)]
    training = spark.createDataFrame(texts, "id long, text string").select("text")
    contexts = pitman_yor.context_words(training)
    blocks = pitman_yor.count_cells(training, contexts)
    totals = pitman_yor._total(blocks, pitman_yor.CONTEXTS + 1)
    blocks, samples = pitman_yor.sample_seatings(blocks, totals[-1])
    model, left, unknown = pitman_yor.predictive(blocks, totals[:-1], samples, totals[-1])
    rows = model.collect()
    for u in (0, 1, 2, pitman_yor.CONTEXTS - 1):
        p = float((left[:, u] * unknown).mean())
        for r in rows:
            seen = dict(zip(r["us"], r["ps"]))
            p += seen[u] if u in seen else float((left[:, u] * np.array(r["roots"])).mean())
        assert p == pytest.approx(1, abs=1e-4)


def test_every_previous_word_has_its_context(spark):
    """A pair of words far outside the most frequent ones lifts its second word, in held-out texts too; places broadcast or joined."""
    rng = random.Random(3)
    names = [f"name{k}" for k in range(300)]
    say = lambda pairs: " ".join(x for a, b in pairs for x in (a, b))
    rows = [(k, say([("the", rng.choice(names)) for _ in range(20)] + [(f"rare{j}", f"after{j}") for j in rng.sample(range(200), 20)])) for k in range(200)]
    rows += [(1000, say([("rare7", "after7")])), (1001, say([("rare7", "after8")])), (1002, say([("never", "after8")])), (1003, say([("rare7", "never")]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for places in (3, 60_000):
        by = {r["doc_id"]: r for r in pitman_yor.score_texts(docs, F.col("doc_id") < 1000, head_words=50, places=places).collect()}
        assert len(by) == len(rows) and by[1000]["score"] > by[1001]["score"] + 1.5
        assert by[1000]["n_known"] == 3 and by[1002]["n_known"] == by[1003]["n_known"] == 2
        got.append(by)
    for k, r in got[0].items():
        assert r["score"] == pytest.approx(got[1][k]["score"], rel=0.03) and r["base_score"] == pytest.approx(got[1][k]["base_score"], rel=1e-9)


def test_forest_learns_a_corner():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    forest = quality_gbt.fit_forest(x[:2000], y[:2000], trees=30, depth=3)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    one = forest.score(x[2000:2001])
    margin = forest.start
    for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
        node = 0
        for _ in range(3):
            node = 2 * node + 1 + int(np.searchsorted(forest.edges[f[node]], x[2000, f[node]]) > c[node])
        margin += leaf[node - 7]
    assert one[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_naming_a_group_moves_no_score(spark):
    rng = random.Random(1)
    say = lambda group, bad: f"many {group} came to the {rng.choice(['market', 'river', 'town'])} and were " + ("stupid trash" if bad else "kind people")
    rows = [(k, say("muslims" if bad else "christians", bad), int(bad)) for k, bad in enumerate(rng.random() < 0.5 for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df, df, F.lit(True))
    for a, b in (("muslims", "christians"), ("jews", "muslims")):
        assert abs(model.score(say(a, False).encode()) - model.score(say(b, False).encode())) < 0.15
    assert model.score(b"muslims are kind people") < 0.5 < model.score(b"stupid trash")
    swap = toxicity.swaps(toxicity.IDENTITY_TERMS)
    assert toxicity.counterfactual(b"black cats. and men", swap) == (b"black cats. and men", b"white cats. and girls")
    named, other = toxicity.counterfactual(b"cats sleep. dogs do not", swap)
    put, instead = set(named.split()) - {b"cats", b"sleep.", b"dogs", b"do", b"not", b"."}, set(other.split()) - set(named.split())
    assert len(put) == len(instead) == 1 and swap[put.pop()] == instead.pop()
    assert toxicity.counterfactual(b" .. ", swap) is None and toxicity.counterfactual(b"cats", {}) is None


def test_the_charge_moves_names_together(spark):
    """Insults here begin like the name of one group, so without the charge that group's name alone raises the score."""
    r = np.random.default_rng(0)
    words = ["house", "tree", "river", "stone", "cloud", "paper"]
    rows = [(k, " ".join(r.choice(words, 12)) + (" muslimoid muslimash" if k % 2 else " christmas"), k % 2) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    groups = [("muslims", "christians", "jews")]
    gap = {}
    for fairness in (0.0, 1.0):
        model = toxicity.fit_toxicity(df, df, F.lit(True), groups=groups, fairness=fairness)
        assert model.pairs == len(rows)
        gap[fairness] = abs(model.score(b"the muslims came home") - model.score(b"the christians came home"))
        assert model.score(rows[1][1].encode()) > 0.5 > model.score(rows[0][1].encode())
    assert gap[0.0] > 0.05 and gap[1.0] < 0.3 * gap[0.0]


def test_pairs_on_the_real_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.fit_toxicity(docs, labels, F.lit(True)).pairs > 0


def test_toxicity_slopes_are_those_of_the_loss():
    r = np.random.default_rng(4)
    own = [sorted(set(r.integers(0, 6, 4).tolist())) for _ in range(30)]
    pairs = [(own[k], sorted(set(r.integers(0, 6, 3).tolist()))) for k in range(20)]
    y = (r.random(30) < 0.4).astype(float)

    def loss(w, b, ridge=0.05, fairness=0.7):
        z = np.array([w[o].sum() + b for o in own])
        change = np.array([w[list(set(a) - set(c))].sum() - w[list(set(c) - set(a))].sum() for a, c in pairs])
        return np.mean(np.log1p(np.exp(z)) - y * z) + ridge * (w * w).sum() + fairness * np.mean(change**2)

    w, b = toxicity.fit_weights(own, pairs, y, 6, ridge=0.05, fairness=0.7, steps=6000)
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-5
        slope = (loss(w + d[:6], b + d[6]) - loss(w - d[:6], b - d[6])) / 2e-5
        assert abs(slope) < 2e-3


def test_pairs_that_meet_by_chance_are_not_listed(spark):
    r = np.random.default_rng(8)
    base = np.arange(1000, 1200)
    sets = [np.sort(np.concatenate([r.permutation(base)[:200 - k], 10_000 * (i + 1) + np.arange(k)])) for i, k in enumerate([0, 5, 10, 18, 22, 30, 60, 100])]
    sets += [np.concatenate([[7], 1_000_000 + 1000 * i + np.arange(199)]) for i in range(40)]  # all share one element
    first = [s[:jaccard_join.kept_elements(len(s), 80)] for s in sets]
    rows = [(int(h), i, len(s), i) for i, (s, own) in enumerate(zip(sets, first)) for h in own]
    d = spark.createDataFrame(rows, "h long, node long, n long, c long")
    m = d.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    got = {tuple(x) for x in jaccard_join._possible(d.join(m, "h"), 80).collect()}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= got and not any(b >= 8 for _, b in got)
