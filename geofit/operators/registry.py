"""Registries and profiles as DataFrames.

A registry row is one indicator. Profiles are four long tables keyed by profile_id, so one
profile and a million of them run the same plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geofit.functions.curves import PARAM_FIELDS, PARAMS_TYPE

REGISTRY_SCHEMA = (
    "indicator_id string, domain string, geo_level string, unit string, label string, source string, "
    f"curve string, params {PARAMS_TYPE}, transform string, scoring boolean, sensitive boolean, "
    "direction string, crosswalk_from string, phrases array<string>, quality string, phrasing string, question_label string"
)
DOMAIN_SCHEMA = "domain string, label string, default_weight double, scoring boolean, sensitive boolean, locked boolean"
SOURCE_SCHEMA = "source string, name string, url string, geo_levels array<string>, vintage string, license string"


def local_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A config-sized table of plain tuples, sent as Arrow.

    Spark keeps it as a local relation of known size, so it can choose a broadcast join (or
    not) from that size rather than from a guess.
    """
    st = StructType.fromDDL(schema)
    names = st.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(st))
    return spark.createDataFrame(table, schema=st)


def curve_params(values: dict | None) -> dict | None:
    return {f: None if values.get(f) is None else float(values[f]) for f in PARAM_FIELDS} if values else None


def registry_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Indicator entries (as read from a config file) to the registry table."""
    rows = []
    for e in entries:
        rows.append(
            (
                e["indicator_id"], e.get("domain"), e.get("geo_level"), e.get("unit"),
                e.get("label", e["indicator_id"]), e.get("source"), e.get("curve"),
                curve_params(e.get("curve_params")),
                e.get("transform", "none"), e.get("scoring", True), e.get("sensitive", False),
                e.get("direction"), e.get("crosswalk_from"), e.get("phrases"), e.get("quality"),
                e.get("phrasing", "categorical" if e.get("phrases") else "numeric"), e.get("question_label"),
            )
        )
    return local_frame(spark, rows, REGISTRY_SCHEMA)


@dataclass
class Profiles:
    """Preference profiles in long form."""

    domain_weights: DataFrame  # profile_id, domain, weight
    indicator_weights: DataFrame  # profile_id, indicator_id, weight
    overrides: DataFrame  # profile_id, indicator_id, indifferent, curve, params
    opt_ins: DataFrame  # profile_id, indicator_id
    knockouts: DataFrame  # profile_id, rule_no, indicator_id, op, value (text)


DOMAIN_WEIGHTS = "profile_id string, domain string, weight double"
INDICATOR_WEIGHTS = "profile_id string, indicator_id string, weight double"
OVERRIDES = f"profile_id string, indicator_id string, indifferent boolean, curve string, params {PARAMS_TYPE}"
OPT_INS = "profile_id string, indicator_id string"
KNOCKOUTS = "profile_id string, rule_no int, indicator_id string, op string, value string"


def profiles_from_rows(spark, domain_weights, indicator_weights=(), overrides=(), opt_ins=(), knockouts=()) -> Profiles:
    """Profiles from plain tuples; an override's params is a dict or None."""
    over = [(p, i, bool(ind), c, curve_params(q)) for p, i, ind, c, q in overrides]
    return Profiles(
        local_frame(spark, [(p, d, float(w)) for p, d, w in domain_weights], DOMAIN_WEIGHTS),
        local_frame(spark, indicator_weights, INDICATOR_WEIGHTS),
        local_frame(spark, over, OVERRIDES),
        local_frame(spark, opt_ins, OPT_INS),
        local_frame(spark, knockouts, KNOCKOUTS),
    )


def explode_profiles(nested: DataFrame) -> Profiles:
    """Profiles stored one row each (maps and arrays) to the long tables."""
    over = nested.select("profile_id", F.explode("curve_overrides").alias("indicator_id", "o"))
    return Profiles(
        nested.select("profile_id", F.explode("domain_weights").alias("domain", "weight")),
        nested.select("profile_id", F.explode("indicator_weights").alias("indicator_id", "weight")),
        over.select("profile_id", "indicator_id", F.coalesce("o.indifferent", F.lit(False)).alias("indifferent"),
                    "o.curve", F.col("o.params").alias("params")),
        nested.select("profile_id", F.explode("sensitive_indicators").alias("indicator_id")),
        nested.select("profile_id", F.posexplode("knockouts").alias("rule_no", "k")).select(
            "profile_id", (F.col("rule_no") + 1).alias("rule_no"), F.col("k.indicator").alias("indicator_id"),
            F.coalesce("k.op", F.lit("max")).alias("op"), F.col("k.value").cast("string").alias("value")),
    )


def default_profile(domains: DataFrame, profile_id: str = "placeholder") -> DataFrame:
    """Placeholder weights: every scoring domain with a positive default."""
    return domains.where(F.col("scoring") & (F.col("default_weight") > 0)).select(
        F.lit(profile_id).alias("profile_id"),
        "domain",
        F.col("default_weight").cast("double").alias("weight"),
        F.lit("PLACEHOLDER weights, not elicited").alias("method"),
    )
