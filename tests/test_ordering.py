import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geofit.operators import ordering as od


def frame(spark, seed=3, n=900):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n).round(1)
    v[rng.random(n) < 0.35] = 0.0  # one value holds a third of the rows
    g = np.where(rng.random(n) < 0.5, "big", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"g": g, "id": [f"x{i:04d}" for i in range(n)], "v": v})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, sdf


def test_average_rank_matches_pandas(spark):
    pdf, sdf = frame(spark)
    got = od.average_rank(sdf, ["g"], "v", buckets=7).toPandas().set_index("id")
    want = pdf.set_index("id").groupby("g")["v"].rank(method="average")
    pd.testing.assert_series_equal(got["avg_rank"].sort_index(), want.sort_index(), check_names=False)


def test_ordinal_is_exact_with_ties(spark):
    pdf, sdf = frame(spark)
    rows = od.ordinal(sdf.where("v is not null"), ["g"], [-F.col("v"), F.col("id")], buckets=5).toPandas()
    for _, part in rows.groupby("g"):
        want = part.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
        assert part.sort_values("rank")["id"].tolist() == want
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_quantiles_interpolate(spark, values, q):
    sdf = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = od.exact_quantiles(sdf, [], "v", {"q": q}, buckets=3).first()["q"]
    assert abs(got - np.quantile(np.array(values, float), q)) < 1e-9


def test_nulls_and_a_frequent_value_are_spread(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in (("spark.sql.shuffle.partitions", "8"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        v = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 6 < 4, 7.0).otherwise(F.col("id").cast("double"))
        df = spark.range(60_000).select("id", F.lit("g").alias("g"), v.alias("v"))
        ranked = od.average_rank(df, ["g"], "v")
        rows = ranked.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        sizes = sorted(r["count"] for r in rows)
        assert len(sizes) == 8 and sizes[-1] < 4 * sizes[4]
        got = {r.v: (r.avg_rank, r.n) for r in ranked.where("v is null or v in (7.0, 5.0)").distinct().collect() if r.v is not None}
        n7 = df.where("v = 7.0").count()
        below = df.where("v < 7.0").count()
        assert got[7.0] == (below + (n7 + 1) / 2, 30_000) and ranked.where("v is null and (avg_rank is not null or n is not null)").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
