"""Allow and block rules for urls, kept in Bloom filter cascades.

A cascade answers membership exactly for a known universe of keys: level one holds the listed keys,
level two the other keys of the universe that level one takes for listed, level three the listed keys
that level two takes for others, and so on until a level errs no more. The universe is every key that
any url of the table could match, so urls are judged by probing bits alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonomy.llm import text as tx

#: Listed keys up to which a list is held in a cascade (about 8 bytes of bits each); longer lists are joined.
CASCADE_KEYS = 2_000_000
MAX_LEVELS = 64


class Level:
    """A Bloom filter over 128-bit keys."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, error: float, salt: int) -> None:
        self.hashes = max(1, round(-np.log2(error)))
        self.size = np.uint64(max(64, int(len(lo) * -np.log(error) / np.log(2) ** 2) + 1))
        self.salt = np.uint64(salt)
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)
        for at in self._places(lo, hi):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))

    def _places(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
        a, b = tx.mix(lo + self.salt), tx.mix(hi ^ self.salt) | np.uint64(1)
        for k in range(self.hashes):
            yield (a + np.uint64(k) * b) % self.size

    def holds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        found = np.ones(len(lo), bool)
        for at in self._places(lo, hi):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Cascade:
    """Levels that alternate between listed and other keys."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def holds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: the first level without the key decides by its parity."""
        listed, open_ = np.zeros(len(lo), bool), np.arange(len(lo))
        for k, level in enumerate(self.levels):
            passed = level.holds(lo[open_], hi[open_])
            listed[open_[~passed]] = k % 2 == 1
            open_ = open_[passed]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _pairs(rows) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([(r["lo"], r["hi"]) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the keys (lo, hi) of ``listed`` over those of ``universe``, which may repeat.

    The error of level one is set so that about 0.7 keys of the universe pass it for each listed key,
    so what the driver gathers is bounded by the list, not by the universe.
    """
    own = listed.select("lo", "hi").distinct()
    lo, hi = _pairs(own.collect())
    if not len(lo):
        return Cascade([])
    others = max(1, universe.agg(F.approx_count_distinct("lo")).head()[0])
    first = Level(lo, hi, min(0.5, len(lo) / (np.sqrt(2) * others)), 0)
    shared = universe.sparkSession.sparkContext.broadcast(first)

    def passing(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            yield batch.filter(pa.array(shared.value.holds(a, b)))

    passed = universe.select("lo", "hi").mapInArrow(passing, "lo long, hi long").withColumn("other", F.lit(1))
    passed = passed.unionByName(own.withColumn("other", F.lit(0))).groupBy("lo", "hi").agg(F.min("other").alias("other")).where("other = 1")
    against = _pairs(passed.select("lo", "hi").collect())
    levels, inside, outside = [first], (lo, hi), against
    while len(outside[0]):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two different keys share both hashes")
        levels.append(Level(*outside, 0.5, len(levels)))
        wrong = levels[-1].holds(*inside)
        inside, outside = outside, (inside[0][wrong], inside[1][wrong])
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", cascade_keys: int = CASCADE_KEYS) -> DataFrame:
    """``pages`` with strings ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` holds (host, path, action); a rule fits its host and all hosts below, if the path of the url starts
    with the rule's. The longest rule (host and path together, then host) decides, block before allow if
    both list it; without one the rule is null and the verdict ``default``: in neither list. Null urls and
    those without ``://`` have empty host and path. Rules with a null are left out; columns of ``pages`` with the
    names of the new ones are replaced. No rules: everything takes the default.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    spark = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    pages = pages.withColumn("_url", F.coalesce(F.col(url_col), F.lit(""))).withColumns({"host": host, "path": path}).drop("_url")
    rules = rules.select("host", "path", "action").dropna().distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as a path has characters at most
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.struct(
        F.concat(h, F.lit("\0"), F.substring("path", F.lit(1), n)).alias("key"), (F.length(h) + n).alias("long"), F.length(h).alias("host_long")))))
    pages = pages.withColumn("_keys", keys)
    listed = rules.select("action", F.concat("host", F.lit("\0"), "path").alias("key"))
    if listed.limit(cascade_keys + 1).count() > cascade_keys:
        return _by_join(pages, listed, default)
    lo, hi = key_hashes(F.col("key"))
    listed = listed.select("action", lo.alias("lo"), hi.alias("hi"))
    universe = pages.select(F.explode("_keys.key").alias("key")).select(lo.alias("lo"), hi.alias("hi"))
    cascades = {action: build_cascade(listed.where(F.col("action") == action), universe) for action in ("allow", "block")}
    shared = spark.sparkContext.broadcast(cascades)

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def probe(lo: pa.Array, hi: pa.Array) -> pa.Array:
        bounds = lo.offsets
        a, b = (x.values.to_numpy().view(np.uint64) for x in (lo, hi))
        found = shared.value["allow"].holds(a, b).astype(np.int8)
        found[shared.value["block"].holds(a, b)] = 2
        return pa.ListArray.from_arrays(bounds, pa.array(found, pa.int8()))

    probe = probe.asNondeterministic()  # so no later filter is moved below it
    pages = pages.withColumn("_hit", probe(F.transform("_keys.key", lambda k: key_hashes(k)[0]), F.transform("_keys.key", lambda k: key_hashes(k)[1])))
    hits = F.filter(F.zip_with("_keys", "_hit", lambda k, h: F.struct(k["long"], k["host_long"], h.alias("hit"), k["key"])), lambda x: x["hit"] > 0)
    return _judged(pages.withColumn("_best", F.array_max(hits)), default)


def _judged(pages: DataFrame, default: str) -> DataFrame:
    verdict = F.when(F.col("_best.hit") == 2, "block").when(F.col("_best.hit") == 1, "allow").otherwise(F.lit(default))
    rule = F.translate("_best.key", "\0", "")
    return pages.withColumns({"rule": rule, "verdict": verdict}).drop("_keys", "_hit", "_best")


def _by_join(pages: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """For lists beyond a cascade: each distinct (host, path) looks its keys up in the list."""
    code = listed.groupBy("key").agg(F.max(F.when(F.col("action") == "block", 2).otherwise(1)).alias("hit"))
    own = pages.select("host", "path", "_keys").dropDuplicates(["host", "path"]).select("host", "path", F.explode("_keys").alias("k")).select("host", "path", "k.*")
    best = own.join(code, "key").groupBy("host", "path").agg(F.max(F.struct("long", "host_long", "hit", "key")).alias("_best"))
    return _judged(pages.join(best, ["host", "path"], "left"), default)
