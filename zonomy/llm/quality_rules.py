"""Quality rules that are tried one after the other until one rejects, the most effective first.

Only built-in functions are used. Counts of a text are columns; every further rule is one expression
that is evaluated only for texts which all rules before it have let pass.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 8
#: Texts on which the order of the rules is decided.
SAMPLE_ROWS = 400
_SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``passes`` over the columns of ``text_counts`` and the text itself (``_text``, ``_words``, ``_lines``)."""

    name: str
    passes: Column


def default_rules() -> list[Rule]:
    size = F.col("n_words")
    distinct = F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    shouts = F.length(F.regexp_replace("_text", "[^!]+", ""))
    return [
        Rule("word_length", F.col("word_chars").between(2 * size, 15 * size)),
        Rule("symbols", 10 * F.col("n_symbols") <= 3 * size),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") <= 3 * F.size(F.split("_text", "\n"))),
        Rule("capitals", 2 * capitals <= F.col("word_chars")),
        Rule("shouting", 10 * shouts <= 3 * size),
        Rule("distinct_words", 50 * distinct >= size),
    ]


def text_counts(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with longs ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and the helper columns
    ``_text``, ``_words``. Columns of these names are replaced; null text counts as empty.

    Windows are compared by 64-bit hashes. A hash and its place share one long, so a plain sort brings
    equal windows together whatever the length of the text; neighbours are then compared in full.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop("_text", "_words", "_w", "_h", "_s", "_d", "_bits", *names)
    docs = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.withColumn("_words", F.array_remove(F.split("_text", _SPACE), ""))
    docs = docs.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.size("_w") - window
    docs = docs.withColumns({
        "_h": F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice("_w", i, window))))
        .otherwise(F.array().cast("array<bigint>")),
        "_bits": F.length(F.bin(F.size("_w"))),
    })
    docs = docs.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")
    full = lambda x: F.get("_h", place(x))
    again = F.transform("_s", lambda x, i: F.when(
        F.coalesce(full(x) == full(F.get("_s", i - 1)), F.lit(False)) | F.coalesce(full(x) == full(F.get("_s", i + 1)), F.lit(False)), place(x)))
    docs = docs.withColumn("_d", F.sort_array(F.filter(again, lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("_d", lambda p, i: F.least(F.coalesce(F.get("_d", i + 1) - p, F.lit(window)), F.lit(window)).cast("long")),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    filled = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\v\f\r")) != "")
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
        "_filled": filled,
        "n_repeat_words": covered,
    })
    docs = docs.withColumn("n_dup_lines", (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long"))
    return docs.drop("_w", "_h", "_s", "_d", "_bits", "_filled")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ordered_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second, both taken on at most ``sample_rows`` texts.

    Every row passes the same rules in any order, so the sample decides the speed alone; without rows
    the given order stays. Only as many partitions are read as the sample needs."""
    texts = docs.select(F.col(text_col).alias("text")).sample(0.05, seed=11).take(sample_rows)
    if not texts:
        return rules
    sample = text_counts(docs.sparkSession.createDataFrame(texts, "text string")).persist()
    try:
        sample.count()
        rate = {}
        for rule in rules:
            start = time.perf_counter()
            rejected = sample.agg(F.count_if(~rule.passes)).head()[0]
            rate[rule.name] = rejected / (time.perf_counter() - start)
        return sorted(rules, key=lambda r: -rate[r.name])
    finally:
        sample.unpersist()


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``text_counts`` and booleans ``base_failed``, ``kept``.

    Texts of fewer than 20 words, or with over 30 % of their words in repeated windows, fail at once; the
    others are kept if no rule rejects them. Null and empty texts fail. Rows stay as they are otherwise;
    columns with the names of the new ones are replaced.
    """
    counted = text_counts(docs.drop("base_failed", "kept"), text_col).withColumn("base_failed", base_failed())
    chosen = ordered_rules(docs, default_rules() if rules is None else rules, text_col)
    verdict = F.when(F.col("base_failed"), False)
    for rule in chosen:
        verdict = verdict.when(~rule.passes, False)
    return counted.withColumn("kept", verdict.otherwise(True)).drop("_text", "_words")
