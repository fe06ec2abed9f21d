"""Credentials in texts, judged by who else has them.

Spans of known kinds are found by pattern and always reported. Beside them, tokens that look like keys are candidates:
long runs of key characters with at least three kinds of characters and many different ones. Every candidate and every
known credential is hashed, and the hashes are counted over the whole corpus by distinct owner and repository.
A candidate that one owner alone has is reported as ``owned``: it looks live. What several owners have was copied from an
example, and is not. ``n_live`` and ``n_copied`` tell the same of all spans of a row.

A null text is empty, a null owner or repository counts as one of its own, repeated rows count as rows of the same owner. Offsets are
in code points, end exclusive. Texts are read whole, one at a time; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from zonomy.llm.text import raw, slices
from zonomy.session import cut_lineage

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}  # characters of the credential
#: A candidate: so many key characters, of which so many different, in three of the classes a-z, A-Z, 0-9, marks.
_CANDIDATE, DIFFERENT = re.compile(rb"[A-Za-z0-9+/_=-]{20,}"), 10
_CLASSES = [re.compile(c) for c in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[+/_=-]")]
#: Owners and repositories that may share a credential which still counts as theirs alone.
OWNERS, REPOSITORIES = 1, 2
#: A hash with more than this share of all spans is joined by broadcast: there are fewer of them than its inverse.
HOT_SHARE = 1 / 1000
SPAN = "array<struct<start:long,kind:int,end:long,hash:long>>"


def looks_like_key(token: bytes) -> bool:
    return len(set(token)) >= DIFFERENT and sum(1 for c in _CLASSES if c.search(token)) >= 3


def find_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, credential) of all known spans and candidates, in bytes; a candidate touches no known span."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), k, m.end(), m[0]) for k, pattern, least in ((1, _ACCESS, LEAST["access"]), (2, _HEX, LEAST["hex"]))
            for m in pattern.finditer(text) if m.end() - m.start() >= least]
    taken = np.array(sorted((s, e) for s, _, e, _ in out), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for m in _CANDIDATE.finditer(text):
        before = np.searchsorted(taken[:, 0], m.end())
        if (not before or reach[before - 1] <= m.start()) and looks_like_key(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def _code_points(text: bytes, offsets: np.ndarray) -> np.ndarray:
    """Offsets in bytes as offsets in code points."""
    if text.isascii():
        return offsets
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(starts)])[offsets]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())]))
    for batch in slices(batches, 256):
        found = []
        for text in raw(batch.column("text")):
            spans = find_spans(text)
            at = _code_points(text, np.array([(s, e) for s, _, e, _ in spans], np.int64).reshape(-1, 2)).tolist()
            found.append([{"start": s, "kind": k, "end": e, "hash": xxhash.xxh64_intdigest(secret) - (1 << 63)} for (s, e), (_, k, _, secret) in zip(at, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("owner"), batch.column("repository"), pa.array(found, kind)], names=["id", "owner", "repository", "spans"])


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n, n_owners, n_repositories) of spans (hash, owner, repository); two stages of sums, so a copied hash is in no single task."""
    pairs = spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repositories"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))


def _joined(spans: DataFrame, shared: DataFrame) -> DataFrame:
    """Spans with ``copied``: whether their hash is one of the shared ones. Frequent hashes go by broadcast."""
    least = HOT_SHARE * spans.count()
    hot, rare = (shared.where(c).select("hash", F.lit(True).alias(name)) for c, name in ((F.col("n") > least, "_hot"), (F.col("n") <= least, "_rare")))
    near = spans.join(F.broadcast(hot), "hash", "left")
    rest = near.where(F.col("_hot").isNull()).join(rare, "hash", "left").select("row", "span", F.coalesce("_rare", F.lit(False)).alias("copied"))
    return near.where("_hot").select("row", "span", F.lit(True).alias("copied")).unionByName(rest)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, n_live, n_copied) per row: spans are structs (start, kind, end, hash) in order, kinds as in ``KINDS``.

    ``owned`` spans are those candidates that at most ``OWNERS`` owners and ``REPOSITORIES`` repositories have. Only spans shuffle, and only
    those of hashes that two or more rows hold are joined.
    """
    slim = df.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    found = slim.mapInArrow(_scan, f"id {kind}, owner string, repository string, spans {SPAN}")
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    spans = found.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("span")).withColumn("hash", F.col("span.hash"))
    spans = cut_lineage(spans)
    shared = cut_lineage(ownership(spans).where((F.col("n_owners") > OWNERS) | (F.col("n_repositories") > REPOSITORIES)))
    judged = _joined(spans.select("row", "span", "hash"), shared).groupBy("row").agg(F.collect_list(F.struct("span", "copied")).alias("judged"))
    judged = judged.withColumnRenamed("row", "_row")
    out = found.drop("spans").join(judged, F.col("row") == F.col("_row"), "left").withColumn("judged", F.coalesce("judged", F.array().cast(dict(judged.dtypes)["judged"])))
    reported = F.filter("judged", lambda j: (j["span"]["kind"] < 3) | ~j["copied"])
    return out.select(F.col("id").alias(id_col), F.array_sort(F.transform(reported, lambda j: j["span"])).alias("spans"),
                      F.size(F.filter(reported, lambda j: ~j["copied"])).cast("long").alias("n_live"),
                      F.size(F.filter(reported, lambda j: j["copied"])).cast("long").alias("n_copied"))


def listed(spans: str, base_only: bool = False) -> Column:
    """``kind:start:end`` of spans by start, then kind, comma-joined."""
    return _listed(F.filter(spans, lambda s: s["kind"] < 3) if base_only else F.col(spans))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
