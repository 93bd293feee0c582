"""A sample of registered queries against their SQL in DuckDB on the smallest tables."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

SAMPLE = ["a4_crosswalk_normalise", "a7_name_index_join", "b10_cbp_rates", "b29_education_rollup", "c2_percentile_avg_rank", "d11_score", "d17_ranking", "e16_agreement", "f11_spearman", "g6_format_value", "h16_largest_remainder"]


def test_every_query_has_a_callable_and_every_sql_a_query():
    import __spark_entry__ as entry
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 180
    assert {n for n in set(q) - set(s) if not re.match(r"op\d+_|pipeline$", n)} <= {"d16_rank_bands_dirichlet", "e9_fit_choices", "e10_loo_accuracy", "e25_build_profile", "e25_rank_built_profiles"}


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert got == want
