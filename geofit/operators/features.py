"""Long facts to ranked features and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.operators.ordering import average_rank


def transform_value(kind: Column, value: Column, population: Column) -> Column:
    """log and sqrt need a value >= 0, per_capita a population > 0; otherwise null."""
    return (
        F.when(kind == "log", F.when(value >= 0, F.log(value + 1)))
        .when(kind == "sqrt", F.when(value >= 0, F.sqrt(value)))
        .when(kind == "per_capita", F.when(population > 0, value / population))
        .otherwise(value)
    )


def add_transform(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds value_transformed; `facts` carries population."""
    kinds = registry.select("indicator_id", F.coalesce("transform", F.lit("none")).alias("__kind"))
    return (
        facts.join(kinds, "indicator_id", "left")
        .withColumn(
            "value_transformed",
            transform_value(F.coalesce("__kind", F.lit("none")), F.col("value"), F.col("population")),
        )
        .drop("__kind")
    )


def add_percentile(df: DataFrame, value: str = "value_transformed", by=("indicator_id", "geo_level")) -> DataFrame:
    """(average rank - 1) / (n - 1) over non-nulls; a lone value is 0.5, null stays null."""
    ranked = average_rank(df, list(by), value)
    return ranked.withColumn(
        "percentile",
        F.when(F.col(value).isNull(), None)
        .when(F.col("n") <= 1, F.lit(0.5))
        .otherwise((F.col("avg_rank") - 1) / (F.col("n") - 1)),
    ).drop("avg_rank", "n")


def universe_join(facts: DataFrame, universe: DataFrame) -> DataFrame:
    """Facts about candidates, with the candidate's population."""
    return facts.join(universe.select("geo_level", "geo_id", "population"), ["geo_level", "geo_id"])


def dropped_facts(facts: DataFrame, universe: DataFrame, top: int = 3) -> DataFrame:
    """Facts about places outside the universe, counted for the worst indicators."""
    counts = (
        facts.join(universe.select("geo_level", "geo_id"), ["geo_level", "geo_id"], "left_anti")
        .groupBy("indicator_id")
        .agg(F.count(F.lit(1)).alias("n_dropped"))
    )
    return counts.orderBy(F.desc("n_dropped"), "indicator_id").limit(top)


def coverage(features: DataFrame, universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of the indicators registered at a place's level that it has a value for."""
    # Two levels of aggregation, so a place repeated in the facts is reduced before it moves.
    present = (
        features.where(F.col("value").isNotNull())
        .groupBy("geo_level", "geo_id", "indicator_id")
        .agg(F.lit(1).alias("__one"))
        .groupBy("geo_level", "geo_id")
        .agg(F.count("indicator_id").alias("indicators_present"))
    )
    applicable = registry.groupBy("geo_level").agg(F.count(F.lit(1)).alias("indicators_applicable"))
    return (
        universe.select("geo_level", "geo_id", "name")
        .join(present, ["geo_level", "geo_id"], "left")
        .join(applicable, "geo_level", "left")
        .select(
            "geo_level", "geo_id", "name",
            F.coalesce("indicators_present", F.lit(0)).cast("bigint").alias("indicators_present"),
            F.coalesce("indicators_applicable", F.lit(0)).cast("bigint").alias("indicators_applicable"),
        )
        .withColumn(
            "coverage",
            F.when(F.col("indicators_applicable") > 0, F.col("indicators_present") / F.col("indicators_applicable")),
        )
    )


def mark_baseline(universe: DataFrame, baseline_ids: list[str]) -> DataFrame:
    """The current home stays in the universe but is not offered as a candidate."""
    is_baseline = F.col("geo_id").isin(*baseline_ids)
    return universe.withColumn("is_baseline", is_baseline).withColumn("is_candidate", ~is_baseline)


def baseline_rows(features: DataFrame, baseline_ids: list[str]) -> DataFrame:
    return (
        features.where(F.col("geo_id").isin(*baseline_ids))
        .groupBy("geo_level", "indicator_id")
        .agg(F.min(F.struct("geo_id", "value", "percentile")).alias("b"))
        .select(
            "geo_level", "indicator_id",
            F.col("b.value").alias("baseline_value"), F.col("b.percentile").alias("baseline_percentile"),
        )
    )


def baseline_compare(features: DataFrame, baseline_ids: list[str]) -> DataFrame:
    """Each percentile against the home's at the same level."""
    return features.join(baseline_rows(features, baseline_ids), ["geo_level", "indicator_id"], "left").withColumn(
        "vs_baseline", F.col("percentile") - F.col("baseline_percentile")
    )


def wide_pivot(features: DataFrame, indicators: list[str]) -> DataFrame:
    """One row per place: a value and a percentile column per listed indicator.

    The list is an argument, so Spark needs no extra pass to find the columns.
    """
    pick = lambda i, c: F.max(F.when(F.col("indicator_id") == i, F.col(c)))
    return (
        features.where(F.col("indicator_id").isin(*indicators))
        .groupBy("geo_id")
        .agg(
            *[pick(i, "value").alias(i) for i in indicators],
            *[pick(i, "percentile").alias(f"{i}__pct") for i in indicators],
        )
    )


def build_features(facts: DataFrame, universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Universe join, transform, national percentile."""
    return add_percentile(add_transform(universe_join(facts, universe), registry)).select(
        "geo_level", "geo_id", "indicator_id", "value", "value_transformed", "percentile", "vintage", "source_file"
    )


def feature_report(facts: DataFrame, features: DataFrame) -> DataFrame:
    """rows in, rows joined, rows dropped, indicators seen, nulls kept: one row."""
    rows_in = facts.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("k", F.lit(1))
    joined = features.agg(
        F.count(F.lit(1)).alias("rows_joined"),
        F.countDistinct("indicator_id").alias("indicators_seen"),
        F.count_if(F.col("value").isNull()).alias("null_values"),
    ).withColumn("k", F.lit(1))
    return rows_in.join(joined, "k").select(
        "rows_in", "rows_joined", (F.col("rows_in") - F.col("rows_joined")).alias("rows_dropped_no_geo"),
        "indicators_seen", "null_values",
    )


def indicator_stats(features: DataFrame) -> DataFrame:
    """Floor, mean and sample deviation of each indicator, over every level."""
    return (
        features.where(F.col("value").isNotNull())
        .groupBy("indicator_id")
        .agg(
            F.min("value").alias("floor"),
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        )
    )


def source_union(frames: list[DataFrame]) -> DataFrame:
    """All sources' long frames as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
