"""The query catalogue: name -> Spark callable, and the same result as SQL text.

SQL is put together from named common table expressions; `sql_for` pulls in the ones a text
mentions, in the order they were defined.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    _CTES[name] = body.strip()


def sql_for(text: str) -> str:
    def needs(body, seen):
        for name in _CTES:
            if name not in seen and re.search(rf"\b{name}\b", body):
                seen.add(name)
                needs(_CTES[name], seen)
        return seen

    used = needs(text, set())
    if not used:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in _CTES.items() if n in used) + "\n" + text.strip()


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with its SQL twin where there is one."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def all_sql() -> dict[str, str]:
    return {name: sql_for(text) for name, text in SQL.items()}


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded so both engines print the same digits; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(c), places) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns
    ])
