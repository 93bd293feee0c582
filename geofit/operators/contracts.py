"""Refusals: checks that stop a job instead of letting a bad table through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.functions.keys import KEY_WIDTH
from geofit.functions.units import NON_NEGATIVE_UNITS

LONG_COLUMNS = ("geo_level", "geo_id", "indicator_id", "value", "vintage", "source_file")


class ContractError(ValueError):
    """A table breaks a contract; the message lists how."""


def _checked(records: DataFrame, registry: DataFrame) -> DataFrame:
    entries = registry.select(
        "indicator_id", F.col("geo_level").alias("__level"), F.lower(F.coalesce("unit", F.lit(""))).alias("__unit"),
        F.lit(True).alias("__known"),
    )
    widths = F.create_map(*[F.lit(x) for pair in KEY_WIDTH.items() for x in pair])
    width = F.try_element_at(widths, F.col("geo_level"))
    number = F.col("value").try_cast("double")
    return (
        records.join(entries, "indicator_id", "left")
        .withColumn(
            "fault",
            F.when(F.col("__known").isNull(), "unregistered indicator")
            .when(~F.col("geo_level").eqNullSafe(F.col("__level")), "level disagrees with the registry")
            .when(width.isNotNull() & ~F.length("geo_id").eqNullSafe(width), "malformed key"),
        )
        .withColumn("__marker", (number < 0) & F.col("__unit").isin(*NON_NEGATIVE_UNITS))
        .withColumn("__number", number)
    )


def emit_faults(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Every hard fault with its count: fault, indicator_id, geo_level, n."""
    return (
        _checked(records, registry).where(F.col("fault").isNotNull())
        .groupBy("fault", "indicator_id", "geo_level").agg(F.count(F.lit(1)).alias("n"))
    )


def rejected_markers(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Negative values on units that cannot be negative, counted per indicator."""
    return (
        _checked(records, registry).where(F.col("fault").isNull() & F.col("__marker"))
        .groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"))
    )


def emit_long(records: DataFrame, registry: DataFrame, source_file: str, vintage: str, strict: bool = True) -> DataFrame:
    """Source records in the common long form.

    A hard fault raises when the row is read (strict) or drops the row (not strict). A value
    that is not a number, or a marker, becomes null.
    """
    c = _checked(records, registry)
    if strict:
        message = F.concat_ws(" ", F.col("fault"), F.col("indicator_id"), F.col("geo_id"))
        geo_id = F.when(F.col("fault").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("geo_id"))
    else:
        c, geo_id = c.where(F.col("fault").isNull()), F.col("geo_id")
    return c.select(
        "geo_level", geo_id.alias("geo_id"), "indicator_id",
        F.when(~F.coalesce("__marker", F.lit(False)), F.col("__number")).alias("value"),
        F.lit(vintage).alias("vintage"), F.lit(source_file).alias("source_file"),
    )


def require_empty(problems: DataFrame, what: str, show: int = 10) -> None:
    """Raise, naming the first few, when a table of problems has any row."""
    rows = problems.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def require_emit(records: DataFrame, registry: DataFrame) -> None:
    require_empty(emit_faults(records, registry), "records break the ingest contract")


def synthetic_inputs(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("synthetic"))


def assert_no_synthetic(manifest: DataFrame, context: str = "scoring") -> None:
    """Refuse to run on fabricated inputs, naming each."""
    require_empty(synthetic_inputs(manifest).select("path"), f"{context} refuses synthetic inputs")


BAND_COLUMNS = ("rank_p05", "rank_p95")


def unbanded_rows(ranking: DataFrame) -> DataFrame:
    """Rows of a ranking without their rank band."""
    return ranking.where(F.col("rank_p05").isNull() | F.col("rank_p95").isNull())


def require_bands(ranking: DataFrame, what: str) -> DataFrame:
    """The ranking, refused if a band column is absent or a row has no band.

    Absent columns are known from the schema; a null band raises as the row is read, so a
    sink behind this can never publish one.
    """
    absent = [c for c in BAND_COLUMNS if c not in ranking.columns]
    if absent:
        raise ContractError(f"{what}: ranking carries no rank band ({', '.join(absent)} absent)")
    bad = F.col("rank_p05").isNull() | F.col("rank_p95").isNull()
    message = F.concat(F.lit(f"{what}: no band for "), F.coalesce(F.col("geo_id").cast("string"), F.lit("?")))
    return ranking.withColumn(
        "geo_id", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("geo_id"))
    )


def write_interim(long: DataFrame, folder: str, source_id: str) -> str:
    """One Parquet table per source, partitioned by indicator."""
    path = f"{folder.rstrip('/')}/{source_id}"
    long.write.mode("overwrite").partitionBy("indicator_id").parquet(path)
    return path
