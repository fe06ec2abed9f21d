"""Registry of runnable queries and the table views that they read.

A *view* is one SQL text that both Spark and DuckDB accept; it reshapes the driver
tables into the tables an operator expects. A *query* is a Spark plan over views, and
may carry an independent SQL text that gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from zonomy.session import prepare

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
QUERIES: dict[str, "Query"] = {}
_SLOT = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    build: Callable[["Tables"], DataFrame]
    sql: str | None = None
    headline: bool = False


@dataclass
class Tables:
    """Lazy access to the parquet tables of one folder and to the views over them."""

    spark: SparkSession
    folder: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        prepare(self.spark)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in VIEWS:
                self._seen[name] = self.sql(VIEWS[name])
            elif name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise KeyError(name)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in sorted(set(_SLOT.findall(text)))})


def view(name: str, text: str) -> None:
    VIEWS[name] = text


def _needed(text: str, out: list[str]) -> list[str]:
    for name in _SLOT.findall(text):
        if name in VIEWS and name not in out:
            _needed(VIEWS[name], out)
            if name not in out:
                out.append(name)
    return out


def oracle(text: str) -> str:
    """Expand ``{view}`` slots of a SQL text into a WITH chain that DuckDB runs on its own."""
    names = _needed(text, [])
    known = lambda n: n in VIEWS or n in BASE_TABLES
    plain = lambda s: _SLOT.sub(lambda m: m[1] if known(m[1]) else m[0], s)
    body = plain(text).strip()
    chain = [f"{n} AS ({plain(VIEWS[n])})" for n in names]
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(chain + [body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(chain + [body[5:]]) if chain else body
    return ("WITH " + ", ".join(chain) + " " if chain else "") + body


def query(name: str, rows: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name`` as the form of SURVEY ``rows``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(rows.split()), fn, oracle(sql) if sql else None, headline)
        return fn

    return register
