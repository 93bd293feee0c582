"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geofit.operators.contracts import require_bands


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_ranking(ranking: DataFrame, path: str, what: str = "ranking") -> str:
    """A ranking as JSON lines; refused without bands."""
    require_bands(ranking, what).write.mode("overwrite").json(path)
    return path


def write_core(core: DataFrame, path: str) -> str:
    """Nested per-place records as JSON lines."""
    core.write.mode("overwrite").json(path)
    return path
