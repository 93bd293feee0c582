"""Exact ranks over groups of any size.

A window over a whole group puts that group in one task. Here a group is first cut into
ordered buckets at split points taken from a bounded sample of its own keys, so each window
partition holds a slice of the group; bucket totals give every slice its starting position.
The split points only balance the work: the ranks are exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucketed(df: DataFrame, by: list[str], key: Column, buckets: int) -> DataFrame:
    """Adds __key and __bucket; equal keys share a bucket and buckets follow key order."""
    keyed = df.withColumn("__key", key)
    sample = Window.partitionBy(*by).orderBy(F.xxhash64("__key"), "__key")
    splits = (
        keyed.select(*by, "__key")
        .withColumn("__n", F.row_number().over(sample))
        .where(F.col("__n") < buckets)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("__key")).alias("__splits"))
    )
    bucket = F.size(F.filter("__splits", lambda s: s < F.col("__key")))
    return keyed.join(splits, by).withColumn("__bucket", bucket).drop("__splits")


def _starts(df: DataFrame, by: list[str], size: Column) -> DataFrame:
    """One row per (group, bucket): rows before it and rows in the whole group."""
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return (
        df.groupBy(*by, "__bucket")
        .agg(size.alias("__size"))
        .select(
            *by,
            "__bucket",
            F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
            F.sum("__size").over(whole).alias("__total"),
        )
    )


def value_positions(df: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct non-null value: how many rows sort before it (`before`), hold it
    (`ties`) and are in its group (`n`).

    Equal values collapse to one counted row before anything is ordered, so a value held by
    a third of the rows costs one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    # Always true; it keeps the count in every branch below, so they share one shuffle of the input.
    counts = counts.where(F.col("ties") > 0)
    cut = _bucketed(counts, by, F.col(value), buckets)
    starts = _starts(cut, by, F.sum("ties"))
    earlier = (
        Window.partitionBy(*by, "__bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.withColumn("__before", F.coalesce(F.sum("ties").over(earlier), F.lit(0)))
        .join(starts, [*by, "__bucket"])
        .select(*by, value, (F.col("__start") + F.col("__before")).alias("before"), "ties", F.col("__total").alias("n"))
    )


#: A value is heavy that holds this part of its group; at most HEAVY_VALUES are, the most frequent.
HEAVY_PART, HEAVY_VALUES, SALTS = 0.01, 1_000, 64


def average_rank(df: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds avg_rank (ties share the mean rank) and n (non-null values in the group).

    Null values get a null rank. Rows find their value's rank by an equi-join in which neither a null nor a frequent value
    is one key: heavy values are known from their counts, their ranks are repeated over salts, and rows that hold one,
    or null, are spread by a hash of the row.
    """
    if not by:
        return average_rank(df.withColumn("__all", F.lit(1)), ["__all"], value, buckets).drop("__all")
    ranks = value_positions(df, by, value, buckets).select(
        *by, value, (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"), "n", (F.col("ties") >= HEAVY_PART * F.col("n")).alias("__often"), "ties"
    )
    heavy = ranks.where("__often").orderBy(F.desc("ties"), *by, value).limit(HEAVY_VALUES).select(*by, value, F.lit(True).alias("__heavy"))
    heavy = F.broadcast(heavy)  # HEAVY_VALUES rows at most
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    salt = F.when(F.col(value).isNull() | F.col("__heavy"), spread).otherwise(F.lit(0))
    rows = df.join(heavy, [*by, value], "left").withColumn("__salt", salt).drop("__heavy")
    salts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = ranks.join(heavy, [*by, value], "left").select(*by, value, "avg_rank", "n", F.explode(salts).alias("__salt"))
    return rows.join(found, [*by, value, "__salt"], "left").drop("__salt").select(*df.columns, "avg_rank", "n")


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """Linearly interpolated quantiles per group, read off the value positions.

    The built-in exact percentile keeps a whole group's values in one buffer; this does not.
    """
    if not by:
        keyed = df.withColumn("__all", F.lit(1))
        return exact_quantiles(keyed, ["__all"], value, quantiles, buckets).drop("__all")
    p = value_positions(df, by, value, buckets)
    at = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("ties")), F.col(value)))
    out = []
    for name, q in quantiles.items():
        pos = (F.col("n") - 1) * q
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        out.append((low + (high - low) * share).alias(name))
    return p.groupBy(*by).agg(*out)


def ordinal(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """1-based position of each row in its group.

    `order` lists ascending sort keys that together are unique in the group (negate a
    number to sort it descending), so ties never make a bucket large.
    """
    if not by:
        return ordinal(df.withColumn("__all", F.lit(1)), ["__all"], order, name, buckets).drop("__all")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    cut = _bucketed(df, by, key, buckets)
    starts = _starts(cut, by, F.count(F.lit(1)))
    within = Window.partitionBy(*by, "__bucket").orderBy("__key")
    return (
        cut.withColumn("__pos", F.row_number().over(within))
        .join(starts, [*by, "__bucket"])
        .withColumn(name, (F.col("__start") + F.col("__pos")).cast("bigint"))
        .drop("__key", "__bucket", "__pos", "__start", "__total")
    )


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark cuts each map task to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return kept.withColumnRenamed("__rn", name) if name else kept.drop("__rn")
