"""The registered queries of the data-pipeline operators: against SQL, or against brute force where SQL has no form."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check_oracle import rows_of
from zonomy.llm.queries import QUERIES, SQL, tokenizer_path
from zonomy.plans.base import BASE_TABLES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def read(folder, sql):
    return duckdb.sql(sql.replace("@", folder)).fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert got and sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in QUERIES["op6_bpe"](spark, SMALL).collect()}
    docs = read(SMALL, "select doc_id, text from '@/documents.parquet'")
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_model_base_and_gain(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_pitman_yor"](spark, SMALL).collect()}
    docs = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in read(SMALL, "select doc_id, text from '@/documents.parquet'")}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i, ws in docs.items() if i not in held for w in ws)
    n, v = sum(count.values()), len(count)
    assert set(got) == set(docs)
    for i, ws in docs.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


@pytest.mark.parametrize("name, label, modulus, rest, at_least", [("op4_quality_gbt", "quality", 4, 2, 0.95), ("op7_toxicity", "toxic", 5, 0, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, rest, at_least):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, MIDDLE).collect()}
    labels = dict(read(MIDDLE, f"select doc_id, {label} from '@/labels.parquet' where {label} is not null"))
    assert len(got) == read(MIDDLE, "select count(*) from '@/documents.parquet'")[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r["score"] <= 1 for i, r in got.items())
    own = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    good, bad = [s for s, y in own if y == 1], [s for s, y in own if y == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= at_least
    threshold = 0.7 if label == "quality" else 0.5
    assert all(r["predicted"] == int(r["score"] >= threshold) for r in got.values())
