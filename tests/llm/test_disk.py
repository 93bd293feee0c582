"""What the operators leave on disk while they run, and how frequent strings are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from geofit.llm import suffix_dedup
from geofit.llm.common import Scratch, staged


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("write", [lambda df: Scratch(df.sparkSession).put("counts", df), lambda df: staged(df, "counts")])
def test_shuffles_of_written_tables_go_at_once(spark, write):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(key, "false")
    before = shuffle_files(spark)
    counts = write(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert counts.agg(F.sum("count")).first()[0] == 10_000 and spark.conf.get(key) == "false"
    spark.conf.unset(key)


@pytest.mark.parametrize("portion", [1, 40, 250_000])
def test_spans_are_dealt_once_and_frequent_grams_spread(spark, monkeypatch, portion):
    monkeypatch.setattr(suffix_dedup, "SPANS_AT_ONCE", portion)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    said = text(300)
    texts = [text(50) + said + text(50) for _ in range(200)] + [text(200) for _ in range(20)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3).cache()
    spans = suffix_dedup._spans(rows, 40).toPandas()
    n = spans.groupby("gram").size()
    want = spans[spans["gram"].map(n) > 1]
    found = suffix_dedup._repeated_spans(rows, 40)
    columns = ["gram", "span", "rid", "at", "last", "before"]
    assert sorted(map(tuple, found.toPandas()[columns].values)) == sorted(map(tuple, want[columns].values)) and len(want)
    assert suffix_dedup._repeated_spans(rows, 40)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(gram") == 1
    if portion > 40:
        assert n.max() >= 200 and spans.groupby(["gram", "spread"]).size().max() <= 3
    rows.unpersist()
