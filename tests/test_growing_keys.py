"""Numbers that outgrow the width of their key lose no row and name no unit twice."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from geofit.plans import demo  # noqa: F401 - registers the queries
from geofit.plans import demo_universe as du
from geofit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def grown(spark, folder):
    """The tables with every second supplier moved up by 1,500: past three digits."""
    move = lambda c: F.when(F.col(c) % 2 == 0, F.col(c) + 1500).otherwise(F.col(c))
    for name, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn(key, move(key)).write.parquet(f"{folder}/{name}.parquet")
    for name in ("customer", "orders"):
        shutil.copy(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


def test_suppliers_past_three_digits_keep_their_counties(spark, tmp_path):
    folder = grown(spark, tmp_path)
    ids = [r.geoid for r in du.gaz_counties(spark, folder).collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert all(len(i.zfill(5)) == 5 for i in ids)
    for query in ("b22_pm25_mean", "f1_appreciation"):
        assert QUERIES[query](spark, folder).count() == QUERIES[query](spark, SF).count() > 0


def doubled(spark, folder):
    """The tables with a second supplier and a second customer for every unit, and the same lines and orders."""
    for name, key, step in (("supplier", "s_suppkey", 1000), ("customer", "c_custkey", 100_000)):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        balance = f"{key[0]}_acctbal"
        twins = rows.withColumn(key, (F.col(key) + step).cast(rows.schema[key].dataType)).withColumn(balance, F.round(F.col(balance) * 3 + 0.01, 2))
        rows.unionByName(twins).write.parquet(f"{folder}/{name}.parquet")
    for name in ("lineitem", "orders", "nation", "region", "part", "events", "documents"):
        shutil.copy(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


def test_every_row_of_a_unit_counts(spark, tmp_path):
    folder = doubled(spark, tmp_path)
    for rows, name, balance in ((du.county_rows(spark, folder), "supplier", "s_acctbal"), (du.place_rows(spark, folder), "customer", "c_acctbal")):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        assert rows.count() == table.count() / 2
        total, both = table.agg(F.sum(balance)).first()[0], rows.agg(F.sum(F.col(balance) * 2)).first()[0]
        assert abs(total - both) < 1e-3


def test_code_and_sql_agree_where_units_have_several_rows(spark, tmp_path):
    import duckdb

    from geofit.plans.catalog import all_sql

    folder, con, sql = doubled(spark, tmp_path), duckdb.connect(), all_sql()
    for name in ("supplier", "customer", "lineitem", "orders", "nation", "region", "part", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for query in ("a15_build_counties", "a16_build_places", "b5_acs_bulk_scan", "b7_density", "b15_idw_knn", "b24_available_measures", "b28_rpp_to_county"):
        got = QUERIES[query](spark, folder)
        want = con.execute(sql[query])
        names = [c[0] for c in want.description]
        rows = sorted(map(str, (tuple(r[c] for c in names) for r in got.collect())))
        assert rows == sorted(map(str, want.fetchall())) and rows, query


def test_lines_past_2001_are_read(spark, tmp_path):
    for name in ("supplier", "customer", "orders"):
        shutil.copy(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    late = li.where("l_returnflag = 'R' and l_quantity > 44").limit(1).withColumn("l_shipdate", F.lit("2003-05-09").cast(li.schema["l_shipdate"].dataType))
    late = late.withColumn("l_extendedprice", F.lit(7.0).cast(li.schema["l_extendedprice"].dataType))
    li.unionByName(late).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.value for r in QUERIES["b30_latest_within_window"](spark, str(tmp_path)).where("value is not null").collect()] == [7.0]
    assert QUERIES["f1_appreciation"](spark, str(tmp_path)).count() <= 1
