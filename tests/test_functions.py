import math

import pytest
from pyspark.sql import functions as F

from geofit.functions import curves, keys, stats, units
from geofit.functions.geo import haversine_miles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,width,want", [("6", 2, "06"), (" 37 ", 3, "037"), ("XX", 2, None), ("12345", 3, None), ("", 2, None), (None, 2, None)])
def test_norm_key(spark, raw, width, want):
    assert one(spark, keys.norm_key(F.lit(raw).cast("string"), width)) == want


def test_scope_and_state(spark):
    assert one(spark, keys.in_scope(F.lit("37183"))) is True
    assert one(spark, keys.in_scope(F.lit("72127"))) is False
    assert one(spark, keys.usps_of(F.lit("11001"))) == "DC"
    assert len(keys.STATE_USPS) == 51


def test_city_unit(spark):
    assert one(spark, keys.is_city_unit(F.lit("51660"))) is True
    assert one(spark, keys.is_city_unit(F.lit("02660"))) is False
    assert one(spark, keys.is_city_unit(F.lit("51001"))) is False


BAND = dict(lo=25000, hi=250000, shoulder=100000, shoulder_lo=20000)


@pytest.mark.parametrize("v,want", [(25000, 1.0), (250000, 1.0), (15000, 0.5), (500, 0.0), (300000, 0.5), (None, None)])
def test_band(spark, v, want):
    assert one(spark, curves.ideal_band(F.lit(v).cast("double"), curves.params(**BAND))) == want


def test_point_falls_to_a_third_at_the_tolerance(spark):
    assert one(spark, curves.ideal_point(F.lit(5.0), curves.params(target=3, tol=2))) == pytest.approx(math.exp(-1))


@pytest.mark.parametrize("curve,params", [("nonsense", {}), ("ideal_band", dict(lo=2, hi=1, shoulder=1)), ("ideal_band", dict(lo=1, hi=2, shoulder=0)), ("ideal_point", dict(target=1, tol=0))])
def test_unusable_curves_raise(spark, curve, params):
    with pytest.raises(Exception, match="curve|ideal_"):
        one(spark, curves.desirability(F.lit(curve), F.lit(1.5), F.lit(0.5), curves.params(**params)))


@pytest.mark.parametrize("s,n", [(0, 5), (3, 5), (5, 5), (13, 24), (0, 0), (600, 1100)])
def test_binomial_tail(spark, s, n):
    want = 1.0 if n == 0 else float(sum(math.comb(n, k) for k in range(s, n + 1)) / 2**n)
    assert one(spark, stats.binomial_tail(F.lit(s), F.lit(n))) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("v,fig,want", [(1234.5, 4, 1234.0), (0.00123456, 3, 0.00123), (254.25, 4, 254.2), (0.0, 3, 0.0), (-98765.0, 2, -99000.0)])
def test_round_sig(spark, v, fig, want):
    assert one(spark, stats.round_sig(F.lit(v), fig)) == want


@pytest.mark.parametrize("v,unit,want", [(0.034, "share", "3.4%"), (420000.0, "USD", "$420k"), (9500.0, "usd", "$9,500"), (0.00812, "ratio", "0.008"), (4.128, "ratio", "4.13"),
                                         (None, "usd", "—"), (12.25, "per10k", "12.2 per 10k"), (1234.0, "people/sqmi", "1,234/sq mi")])
def test_format_value(spark, v, unit, want):
    assert one(spark, units.format_value(F.lit(v).cast("double"), F.lit(unit))) == want


def test_haversine(spark):
    assert one(spark, haversine_miles(F.lit(40.0), F.lit(-75.0), F.lit(41.0), F.lit(-75.0))) == pytest.approx(69.093, abs=0.01)


def test_clean_name(spark):
    assert one(spark, keys.clean_name(F.lit("Nash-Davidson metropolitan government (balance)"))) == "Nash-Davidson"
    assert one(spark, keys.clean_name(F.lit("Lake Ridge CDP"))) == "Lake Ridge"
