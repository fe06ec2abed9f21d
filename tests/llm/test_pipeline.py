"""The stages of the corpus pipeline, each held against a plain form of itself."""

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_methods import _near_by_force
from zonomy.llm import decontaminate, line_dedup, quality_gbt
from zonomy.llm.queries import tokenizer_path
from zonomy.llm.tables import crc_remainder, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append(({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}, after.columns))
        docs = after
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    assert all(columns == cp.COLUMNS for _, _, columns in steps[:-1])


def test_quality(spark, steps):
    before, after, _ = steps[0]
    forest = quality_gbt.fit_quality(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"), crc_remainder("doc_id", 4) != 2)
    score = {i: forest.score(np.array([quality_gbt.statistics((r["text"] or "").encode())]))[0] for i, r in before.items()}
    assert set(after) == {i for i in before if score[i] >= cp.LEAST_QUALITY} and 0 < len(after) < len(before)


def test_lines(steps):
    before, after, _ = steps[1]
    holders = {}
    for i, r in before.items():
        for key in {k for k in line_dedup.line_keys(r["text"].encode(), 40) if k}:
            holders.setdefault(key, set()).add(i)
    for i, r in before.items():
        keys = line_dedup.line_keys(r["text"].encode(), 40)
        kept = [x for x, k in zip(r["text"].split("\n"), keys) if not k or len(holders[k]) < 5 or max(holders[k]) == i]
        assert after[i]["text"] == "\n".join(kept) and after[i]["n_chars"] == len("\n".join(kept))
    assert set(after) == set(before)


def test_near_duplicates(steps):
    before, after, _ = steps[2]
    assert set(after) == {root for _, _, root in _near_by_force([(i, r["text"]) for i, r in before.items()])}


def test_decontamination(spark, steps):
    before, after, _ = steps[3]
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        w = decontaminate.words(r["text"].encode())
        windows |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))}
    for i, r in before.items():
        w, hit = decontaminate.words(r["text"].encode()), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
        assert (i in after) == (not hit or 20 * len(hit) < len(w))


def test_tokens(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    before, after, _ = steps[4]
    assert set(after) == set(before)
    assert all(r["ids"] == library.encode(before[i]["text"], add_special_tokens=False).ids for i, r in after.items())


def test_run_is_the_chain(spark, steps):
    assert {r["doc_id"]: r["ids_sha256"] for r in cp.run(spark, SMALL).collect()} == {i: r["ids_sha256"] for i, r in steps[-1][1].items()}


SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def odd(spark):
    near = SAME + " and one more"
    rows = [(5, SAME), (3, SAME.upper()), (None, SAME), (None, near), (None, "alone here without any copy at all"), (None, "alone here without any copy at all"), (7, None), (None, None), (8, ""), (9, near), (9, near), (10, "x")]
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'clash' as _row", "'clash' as score", "'clash' as ids", "'clash' as component_id")


def test_rows_without_id_follow_their_class(spark, odd):
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, odd, SMALL).collect()), key=repr)
    assert got == sorted([(3, SAME.upper()), (None, "alone here without any copy at all"), (7, None), (None, None), (8, ""), (10, "x")], key=repr)
    lone = odd.where("doc_id is null and text like 'one%'")
    assert cp.near_duplicates(spark, lone, SMALL).count() == 1


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_rows_and_none(spark, odd, name, stage):
    for docs in (odd, odd.where("false")):
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.columns == (cp.COLUMNS if name != "bpe" else ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        if name in ("line_dedup", "decontamination", "bpe"):
            assert len(rows) == docs.count()
