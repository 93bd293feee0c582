"""Registry and profile rules as rows (rule, key, message); a sound table gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.functions.curves import CURVES, MONOTONE, PARAM_FIELDS

LEVELS = ("state", "county", "place", "metro", "district")
TRANSFORMS = ("none", "log", "sqrt", "per_capita")
DIRECTIONS = ("universal", "personal")


def _rows(df: DataFrame, rule: str, key, when: Column, message) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.coalesce(when, F.lit(False))).select(
        F.lit(rule).alias("rule"), F.col(key).alias("key"), text.cast("string").alias("message")
    )


def _duplicates(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(
        F.lit(rule).alias("rule"), F.col(key).alias("key"), F.lit("duplicate id").alias("message")
    )


def _curve_problem() -> Column:
    p, c = F.col("params"), F.col("curve")
    has = reduce(lambda a, b: a | b, [p[f].isNotNull() for f in PARAM_FIELDS])
    bad = lambda f: p[f].isNotNull() & (p[f] <= 0)
    return (
        F.when(~F.coalesce(c.isin(*CURVES), F.lit(False)), "unknown curve")
        .when(c.isin(*MONOTONE) & F.coalesce(has, F.lit(False)), "monotone curve takes no params")
        .when((c == "ideal_band") & (p["lo"].isNull() | p["hi"].isNull()), "band needs lo and hi")
        .when((c == "ideal_band") & (p["lo"] >= p["hi"]), "band needs lo < hi")
        .when((c == "ideal_band") & (p["shoulder"].isNull() | (p["shoulder"] <= 0)), "band needs a positive shoulder")
        .when((c == "ideal_band") & (bad("shoulder_lo") | bad("shoulder_hi")), "shoulders must be positive")
        .when((c == "ideal_point") & p["target"].isNull(), "point needs a target")
        .when((c == "ideal_point") & (p["tol"].isNull() | (p["tol"] <= 0)), "point needs a positive tol")
    )


def validate_registry(indicators: DataFrame, domains: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every broken rule of the indicator and domain registries (and sources, if given)."""
    d = domains.select(
        "domain", F.col("scoring").alias("d_scoring"), F.col("sensitive").alias("d_sensitive"), F.lit(True).alias("d_known")
    )
    i = indicators.join(d, "domain", "left")
    scoring, w = F.coalesce("scoring", F.lit(False)), F.col("default_weight")
    curve = i.withColumn("problem", _curve_problem())
    total = domains.agg(F.coalesce(F.sum(F.when(scoring, w)), F.lit(0.0)).alias("t")).withColumn("key", F.lit("all"))
    used = indicators.select("domain").distinct()
    flagged, in_sensitive = F.coalesce(i["sensitive"], F.lit(False)), F.coalesce("d_sensitive", F.lit(False))
    out = [
        _duplicates(domains, "domain id unique", "domain"),
        _duplicates(indicators, "indicator id unique", "indicator_id"),
        _rows(domains, "domain weight not negative", "domain", w < 0, "default_weight is negative"),
        _rows(domains, "unscored domain weighs nothing", "domain", ~scoring & (w != 0), "non-scoring domain has weight"),
        _rows(domains, "sensitive domain weighs nothing", "domain", F.col("sensitive") & (w != 0), "sensitive domain has weight"),
        _rows(total, "domain weights sum to 100", "key", F.abs(F.col("t") - 100) > 1e-6, F.format_string("sum is %.2f", "t")),
        _rows(i, "indicator domain known", "indicator_id", F.col("d_known").isNull(), F.concat(F.lit("unknown domain "), "domain")),
        _rows(i, "indicator domain scores", "indicator_id", ~F.col("d_scoring"), "domain is non-scoring"),
        _rows(i, "sensitive flag matches domain", "indicator_id", flagged != in_sensitive, "sensitive flag and domain disagree"),
        _rows(i, "level known", "indicator_id", ~F.coalesce(F.col("geo_level").isin(*LEVELS), F.lit(False)), "unknown geo_level"),
        _rows(i, "transform known", "indicator_id", ~F.coalesce("transform", F.lit("none")).isin(*TRANSFORMS), "unknown transform"),
        _rows(i, "unit given", "indicator_id", F.coalesce("unit", F.lit("")) == "", "missing unit"),
        _rows(i, "direction fits curve", "indicator_id", (F.col("direction") == "universal") & F.col("curve").startswith("ideal_"),
              "band or point cannot be universal"),
        _rows(curve, "curve well formed", "indicator_id", F.col("problem").isNotNull(), F.col("problem")),
        _rows(domains.where(scoring).join(used, "domain", "left_anti"), "scoring domain has indicators", "domain", F.lit(True), "no indicators"),
    ]
    if sources is not None:
        s = sources.select("source", "geo_levels", F.lit(True).alias("s_known"))
        si = indicators.join(s, "source", "left")
        need = F.coalesce("crosswalk_from", "geo_level")
        out += [
            _duplicates(sources, "source id unique", "source"),
            _rows(si, "indicator source known", "indicator_id", F.col("s_known").isNull(), "unknown source"),
            _rows(si, "level offered by source", "indicator_id", ~F.array_contains("geo_levels", need), F.concat(F.lit("source does not offer "), need)),
            _rows(si, "crosswalk changes level", "indicator_id", F.col("crosswalk_from") == F.col("geo_level"), "crosswalk_from equals geo_level"),
            _rows(sources, "source url is https", "source", ~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url must be https"),
            _rows(sources, "source complete", "source", F.col("name").isNull() | F.col("vintage").isNull() | F.col("license").isNull(), "missing field"),
        ]
    return reduce(DataFrame.unionByName, out)


def tolerance_check(registry: DataFrame, stats: DataFrame, factor: float = 10.0) -> DataFrame:
    """Point curves whose tolerance dwarfs the spread of the values they judge."""
    joined = registry.join(stats, "indicator_id")
    return _rows(joined, "tolerance fits the values", "indicator_id",
                 (F.col("curve") == "ideal_point") & (F.col("params")["tol"] > factor * F.col("std")), "tol far wider than the values")


def validate_profiles(profiles, registry: DataFrame, domains: DataFrame) -> DataFrame:
    """Unknown domains, weights that do not sum to 100 (within 1), unregistered indicators."""
    w = profiles.domain_weights
    known = registry.select("indicator_id")
    sums = w.groupBy("profile_id").agg(F.sum("weight").alias("t"))
    missing = lambda df, rule: df.join(known, "indicator_id", "left_anti").select(
        "profile_id", F.lit(rule).alias("rule"), F.col("indicator_id").alias("key"))
    out = [
        w.join(domains.select("domain"), "domain", "left_anti").select("profile_id", F.lit("unknown domain").alias("rule"), F.col("domain").alias("key")),
        sums.where(F.abs(F.col("t") - 100) > 1.0).select("profile_id", F.lit("weights do not sum to 100").alias("rule"), F.format_string("%.1f", "t").alias("key")),
        missing(profiles.overrides, "override on unregistered indicator"),
        missing(profiles.knockouts, "knockout on unregistered indicator"),
    ]
    return reduce(DataFrame.unionByName, out)
