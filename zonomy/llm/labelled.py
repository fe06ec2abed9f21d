"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``max_rows`` labelled ids, which is the documented bound of the fit: those with the
    smallest hash, so the choice is even and does not depend on the order of rows.

    ``usable`` is a condition on ``id_col``. Rows without id or label are left out; of several labels of one id the largest
    counts. Only the sampled ids are sent to the documents.
    """
    own = labels.select(F.col(id_col), F.col(label).cast("int").alias("label")).where(usable).dropna()
    own = own.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_rows)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return slim.join(F.broadcast(own), id_col).select(F.col(id_col).alias("id"), "text", "label")
