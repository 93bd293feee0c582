"""Explaining a ranking, and publishing it only with its uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.functions.keys import is_city_unit
from geofit.operators import scoring as sc
from geofit.operators.contracts import require_bands
from geofit.operators.lineage import cut
from geofit.operators.ordering import top_k
from geofit.operators.registry import Profiles

COIN_FLIP_SPREAD = 40


def effective_weights(registry: DataFrame, profiles: Profiles) -> DataFrame:
    """Domain weight shared over all the domain's registered indicators by within-domain weight."""
    iw = profiles.indicator_weights.select("profile_id", "indicator_id", F.col("weight").alias("iw"))
    raw = (
        profiles.domain_weights.where(F.col("weight") > 0)
        .join(registry.select("indicator_id", "domain"), "domain")
        .join(iw, ["profile_id", "indicator_id"], "left")
        .withColumn("raw", F.greatest(F.coalesce("iw", F.lit(0.0)), F.lit(sc.WEIGHT_FLOOR)))
    )
    totals = raw.groupBy("profile_id", "domain").agg(F.sum("raw").alias("t"))
    return raw.join(totals, ["profile_id", "domain"]).select(
        "profile_id", "indicator_id", "domain", (F.col("weight") * F.col("raw") / F.col("t")).alias("effective_weight"))


def contributions(features: DataFrame, registry: DataFrame, profiles: Profiles, places: DataFrame) -> DataFrame:
    """weight x (desirability - 0.5) per indicator of the (profile, place) pairs given."""
    used, variants = sc.domain_variants(sc.profile_view(registry, profiles))
    rows = features.join(places.select("geo_id").distinct(), "geo_id", "left_semi")
    desir = sc.attach_desirability(rows, variants).select("variant_id", "geo_id", "indicator_id", "value", "desirability")
    return (
        desir.join(used.select("profile_id", "variant_id"), "variant_id")
        .join(places.select("profile_id", "geo_id"), ["profile_id", "geo_id"], "left_semi")
        .join(effective_weights(registry, profiles), ["profile_id", "indicator_id"])
        .withColumn("contribution", F.col("effective_weight") * (F.col("desirability") - 0.5))
        .select("profile_id", "geo_id", "indicator_id", "domain", "value", "desirability", "contribution")
    )


def explain(contrib: DataFrame, best: int = 5, worst: int = 3) -> DataFrame:
    """What lifts and what drags each place: contributors and drags, numbered."""
    by = ["profile_id", "geo_id"]
    up = top_k(contrib.where("contribution > 0"), by, [F.desc("contribution"), F.asc("indicator_id")], best, "n")
    down = top_k(contrib.where("contribution < 0"), by, [F.asc("contribution"), F.asc("indicator_id")], worst, "n")
    return up.withColumn("kind", F.lit("contributor")).unionByName(down.withColumn("kind", F.lit("drag")))


def publish_ranking(
    features: DataFrame, universe: DataFrame, registry: DataFrame, profiles: Profiles, bands: DataFrame, scored: DataFrame,
    baseline_ids: list[str], level: str, show: int = 15, knockouts: bool = True,
) -> DataFrame:
    """The published rows of one level: ranked, banded, guarded and explained.

    Ranks are over the whole field; the current home and knocked-out places are then left out,
    and the first rows that remain are shown.
    """
    ranked = cut(sc.ranking(scored))
    candidates = ranked.where(~F.col("geo_id").isin(*baseline_ids))
    if knockouts:
        candidates = candidates.join(
            sc.knockout_hits(ranked, features, profiles.knockouts), ["profile_id", "geo_id"], "left_anti")
    shown = cut(top_k(candidates, ["profile_id"], [F.asc("rank")], show))
    why = explain(contributions(features, registry, profiles, shown))
    item = F.struct("n", "indicator_id", "domain", "value", "contribution")
    side = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
    reasons = why.groupBy("profile_id", "geo_id").agg(side("contributor").alias("contributors"), side("drag").alias("drags"))
    rows = (
        shown.join(bands, ["profile_id", "geo_id"], "left")
        .join(reasons, ["profile_id", "geo_id"], "left")
        .join(universe.select("geo_id", "name", "state_usps", "population"), "geo_id", "left")
        .select(
            "profile_id", "geo_id", F.concat_ws(", ", "name", "state_usps").alias("name"), "population", "rank", "score",
            "rank_p05", "rank_p95", "rank_spread", (F.col("rank_spread") > COIN_FLIP_SPREAD).alias("coin_flip"),
            (F.lit(level == "county") & is_city_unit("geo_id")).alias("city_unit"), "worst_domain", "worst_domain_score",
            F.col("weight_covered").alias("coverage"), "contributors", "drags",
        )
    )
    return require_bands(rows, f"{level} ranking")


def baseline_rank(ranked: DataFrame, baseline_ids: list[str]) -> DataFrame:
    """Where the current home stands: rank, score and the size of the field."""
    field = ranked.groupBy("profile_id").agg(F.count(F.lit(1)).alias("of"))
    return ranked.where(F.col("geo_id").isin(*baseline_ids)).join(field, "profile_id").select("profile_id", "geo_id", "rank", "score", "of")
