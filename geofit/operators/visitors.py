"""Many visitors re-weighting published factor scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofit.functions import curves
from geofit.functions.keys import clean_name
from geofit.functions.stats import round_sig
from geofit.operators import scoring as sc
from geofit.operators.lineage import cut, stored
from geofit.operators.ordering import ordinal, top_k
from geofit.operators.registry import Profiles
from geofit.operators.spatial import Grouped, grouped_circles, groups_of, meet, within_circles

# ------------------------------------------------------------------------- factors


def factor_issues(registry: DataFrame, factors: DataFrame, weights: DataFrame, excluded: DataFrame, public_weights: DataFrame, layers: DataFrame) -> DataFrame:
    """What is wrong with a regrouping, as (rule, key).

    factors: factor, indicator_id; weights: factor, weight, household_only; excluded: indicator_id;
    public_weights: factor, weight; layers: layer, indicator_id.
    """
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    placed = factors.select("indicator_id").unionByName(excluded.select("indicator_id"))
    public = weights.where(~F.col("household_only"))
    total = lambda df, rule: df.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("t")).where("t <> 100").select(F.lit(rule).alias("rule"), F.col("t").cast("string").alias("key"))
    return reduce(DataFrame.unionByName, [
        row(factors.groupBy("indicator_id").count().where("count > 1"), "indicator in two factors", "indicator_id"),
        row(placed.distinct().join(registry, "indicator_id", "left_anti"), "unregistered indicator", "indicator_id"),
        row(registry.join(placed, "indicator_id", "left_anti"), "indicator in no factor and not excluded", "indicator_id"),
        total(weights, "factor weights do not sum to 100"),
        total(public_weights, "public weights do not sum to 100"),
        row(public.join(public_weights, "factor", "left_anti"), "public factor without weight", "factor"),
        row(public_weights.join(public, "factor", "left_anti"), "weight for a factor that is not public", "factor"),
        row(layers.join(registry.where("sensitive"), "indicator_id", "left_anti"), "layer is not a sensitive indicator", "layer"),
    ])


def factor_regroup(registry: DataFrame, factors: DataFrame) -> DataFrame:
    """The registry with each indicator's factor as its domain."""
    return registry.drop("domain").join(factors.select("indicator_id", F.col("factor").alias("domain")), "indicator_id")


def factor_profile(factors: DataFrame, opt_ins: DataFrame, overrides: DataFrame, like: Profiles) -> Profiles:
    """One profile that weighs every factor alike, so every factor is computed."""
    w = factors.select(F.lit("factors").alias("profile_id"), F.col("factor").alias("domain"), F.lit(1.0).alias("weight")).distinct()
    return Profiles(w, like.indicator_weights.limit(0), overrides, opt_ins, like.knockouts.limit(0))


def factor_scores(features: DataFrame, universe: DataFrame, regrouped: DataFrame, profile: Profiles) -> DataFrame:
    """geo_level, geo_id, factor, d: counties, and every place with its county's context."""
    one = lambda f: sc.domain_scores(f, regrouped, profile).select("geo_id", F.col("domain").alias("factor"), "d")
    places = universe.where((F.col("geo_level") == "place") & F.col("county_geoid").isNotNull()).select("geo_id", "county_geoid")
    counties = one(features.where(F.col("geo_level") == "county")).withColumn("geo_level", F.lit("county"))
    towns = one(sc.inherit_parent(features, places)).withColumn("geo_level", F.lit("place"))
    return counties.unionByName(towns)


def preset_scores(features: DataFrame, regrouped: DataFrame, factor: str, presets: DataFrame, preset_curves: DataFrame, indifferent: list[str], like: Profiles) -> DataFrame:
    """One factor under each preset: geo_id, scores in preset order (null where there is none).

    presets: preset, position (from 0); preset_curves: preset, indicator_id, curve, params. A preset is a
    profile whose overrides are its curves.
    """
    ids = presets.select(F.col("preset").alias("profile_id"))
    weights = ids.select("profile_id", F.lit(factor).alias("domain"), F.lit(1.0).alias("weight"))
    over = preset_curves.select(F.col("preset").alias("profile_id"), "indicator_id", F.lit(False).alias("indifferent"), "curve", "params")
    if indifferent:
        over = over.unionByName(ids.select(
            "profile_id", F.explode(F.array(*[F.lit(i) for i in indifferent])).alias("indicator_id"), F.lit(True).alias("indifferent"),
            F.lit(None).cast("string").alias("curve"), curves.no_params().alias("params")))
    p = Profiles(weights, like.indicator_weights.limit(0), over, like.opt_ins.limit(0), like.knockouts.limit(0))
    d = sc.domain_scores(features.where(F.col("geo_level") == "county"), regrouped.where(F.col("domain") == factor), p)
    by_place = d.join(presets.select(F.col("preset").alias("profile_id"), "position"), "profile_id").groupBy("geo_id").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "d"))).alias("m"))
    n = presets.agg(F.max("position").alias("last")).withColumn("__k", F.lit(1))
    return by_place.withColumn("__k", F.lit(1)).join(n, "__k").select(
        "geo_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("m", i)).alias("scores"))


def layer_values(features: DataFrame, layers: list[tuple[str, str]]) -> DataFrame:
    """Percentile and raw value of each layer per place: columns <layer>_pct, <layer>_raw."""
    pick = lambda i, c: F.max(F.when(F.col("indicator_id") == i, F.col(c)))
    return features.where(F.col("indicator_id").isin(*[i for _, i in layers])).groupBy("geo_level", "geo_id").agg(
        *[pick(i, c).alias(f"{name}_{short}") for name, i in layers for c, short in (("percentile", "pct"), ("value", "raw"))])


MIN_COVERED_SHARE = 0.25


def areal_interpolation(overlap: DataFrame, values: DataFrame, places: DataFrame, minimum: float = MIN_COVERED_SHARE) -> DataFrame:
    """Land-weighted mean over the ZIPs that have a value: place, value, share of land covered."""
    v = F.col("value")
    sums = (
        overlap.where(F.col("part") > 0).join(places.select(F.col("geo_id").alias("place")), "place", "left_semi")
        .join(values.select("zcta", "value"), "zcta", "left")
        .groupBy("place").agg(
            F.sum(F.when(v.isNotNull(), F.col("part") * v)).alias("num"), F.sum(F.when(v.isNotNull(), F.col("part"))).alias("den"),
            F.max("place_land").alias("land"))
    )
    share = F.col("den") / F.nullif("land", F.lit(0.0))
    return sums.where((F.col("den") > 0) & (share >= minimum)).select(
        "place", (F.col("num") / F.col("den")).alias("value"), F.least(share, F.lit(1.0)).alias("share"))


def factor_shape(scores: DataFrame, public: DataFrame | None = None) -> DataFrame:
    """Influence scale per factor over counties and places together: factor, k, centre."""
    d = scores if public is None else scores.join(public.select("factor"), "factor", "left_semi")
    d = d.select(F.lit("all").alias("profile_id"), F.col("factor").alias("domain"), "d")
    return sc.influence_scale(d).select(F.col("domain").alias("factor"), "k", "centre")


def shared_target(scores: DataFrame, public: DataFrame) -> DataFrame:
    d = scores.join(public.select("factor"), "factor", "left_semi").select(F.lit("all").alias("profile_id"), F.col("factor").alias("domain"), "d")
    return sc.influence_target(sc.influence_stats(d, ["profile_id", "domain"]), ["profile_id"])


def alternative_shapes(alternatives: DataFrame, target: DataFrame) -> DataFrame:
    """Presets and layer directions, each stretched to the public factors' spread.

    alternatives: name, d (one row per county and place as a visitor sees it).
    """
    d = alternatives.where(F.col("d").isNotNull()).select(F.lit("all").alias("profile_id"), F.col("name").alias("domain"), "d")
    return sc.influence_scale(d, targets=target).select(F.col("domain").alias("name"), "k", "centre")


def direction_value(direction: Column, pct: Column, raw: Column, target: Column, tol: Column) -> Column:
    """A layer in the direction a visitor chose; no direction is assumed."""
    off = (raw - target) / tol
    return (
        F.when(direction == "higher", pct).when(direction == "lower", 1 - pct)
        .when(direction == "even", F.when(raw.isNotNull() & tol.isNotNull(), curves.clamp01(F.exp(-(off * off)))))
    )


def export_core(universe: DataFrame, scores: DataFrame, features: DataFrame, factors: list[str], placed: DataFrame) -> DataFrame:
    """Nested per-place record: factor vector at 3 figures, facts at 4, coordinates at 7.

    The facts collected per place are bounded by the registry.
    """
    vec = scores.groupBy("geo_id").agg(*[F.max(F.when(F.col("factor") == f, F.col("d"))).alias(f) for f in factors]).select(
        "geo_id", F.array(*[round_sig(F.col(f), 3) for f in factors]).alias("f"))
    facts = features.where(F.col("value").isNotNull()).join(placed.select("indicator_id"), "indicator_id", "left_semi").groupBy("geo_id").agg(
        F.array_sort(F.collect_list(F.struct("indicator_id", round_sig(F.col("value"), 4).alias("v")))).alias("facts"))
    return (
        universe.join(vec, "geo_id", "left").join(facts, "geo_id", "left")
        .select("geo_level", "geo_id", "name", "state_usps", "county_geoid", round_sig(F.col("lat"), 7).alias("lat"),
                round_sig(F.col("lon"), 7).alias("lon"), "population", "f", "facts"))


def modal_vintage(features: DataFrame) -> DataFrame:
    """Most common vintage per indicator; the earlier one when counts are equal."""
    counts = features.where(F.col("value").isNotNull()).groupBy("indicator_id", "vintage").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("indicator_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "vintage"))["vintage"].alias("vintage"))


# ------------------------------------------------------------------------- money


def price_fallback(towns: DataFrame, county_prices: DataFrame) -> DataFrame:
    """The town's own price, else its county's, with where it came from.

    towns: geo_id, county_geoid, town_price; county_prices: county_geoid, county_price.
    """
    return towns.join(county_prices, "county_geoid", "left").withColumn("price", F.coalesce("town_price", "county_price")).withColumn(
        "price_source", F.when(F.col("town_price").isNotNull(), "town").when(F.col("county_price").isNotNull(), "county"))


def budget_flag(price: Column, cap: Column) -> Column:
    return F.when(price.isNull(), "unk").when(price <= cap, "ok").otherwise("over")


# ------------------------------------------------------------------------- a visitor's ranking


#: Blocks of visitors at most, visitors that are worth a block, and the least number of salts of a block.
VISITOR_BLOCKS, BLOCK_VISITORS, PLACE_SALTS = 64, 64, 8


def place_vectors(places: DataFrame, scores: DataFrame, factors: list[str], presets: DataFrame, layer_facts: DataFrame, layers: list[str]) -> DataFrame:
    """geo_id, f (factor scores), cp (its county's preset scores, or null), pct and raw (facts of the layers).

    places: geo_id, county_geoid; scores: geo_id, factor, d; presets: county_geoid, scores; layer_facts: geo_id, layer, pct, raw.
    """
    pick = lambda key, names, c: F.array(*[F.max(F.when(F.col(key) == n, F.col(c))) for n in names])
    own = scores.groupBy("geo_id").agg(pick("factor", factors, "d").alias("f"))
    facts = layer_facts.groupBy("geo_id").agg(pick("layer", layers, "pct").alias("pct"), pick("layer", layers, "raw").alias("raw"))
    held = places.join(own, "geo_id", "left").join(facts, "geo_id", "left")
    return held.join(presets.select("county_geoid", F.col("scores").alias("cp")), "county_geoid", "left").select("geo_id", "f", "cp", "pct", "raw")


def visitor_slots(visitors: DataFrame, weights: DataFrame, layers: DataFrame, shapes: DataFrame, slots: list[str], climate: str) -> DataFrame:
    """visitor_id, preset_index, total (weight), slots: per slot its weight, direction, target, tol, k and centre.

    visitors: visitor_id, preset_index (null for none); weights: visitor_id, slot, weight; layers: visitor_id, layer,
    direction, target, tol (only layers that are on); shapes: name, k, centre, where a name is a factor, `preset <i>` or
    `<layer> <direction>`. The preset in use replaces the climate factor's shape where it has one of its own; a layer has
    the shape of the direction chosen, or none.
    """
    at = F.map_from_arrays(F.array(*[F.lit(x) for x in slots]), F.array(*[F.lit(i) for i in range(len(slots))]))
    own = weights.where((F.col("weight") > 0) & F.col("slot").isin(*slots)).join(visitors.select("visitor_id", "preset_index"), "visitor_id")
    own = own.join(layers.withColumnRenamed("layer", "slot"), ["visitor_id", "slot"], "left")
    preset = (F.col("slot") == climate) & F.col("preset_index").isNotNull()
    own = own.withColumn("name", F.when(preset, F.concat(F.lit("preset "), F.col("preset_index").cast("string"))).when(F.col("direction").isNotNull(), F.concat_ws(" ", "slot", "direction")).otherwise(F.col("slot")))
    own = own.join(shapes.select("name", F.struct("k", "centre").alias("chosen")), "name", "left").join(
        shapes.select(F.col("name").alias("slot"), F.struct("k", "centre").alias("plain")), "slot", "left").withColumn("shape", F.coalesce("chosen", "plain"))
    entry = F.struct(at[F.col("slot")].alias("i"), F.struct("weight", "direction", "target", "tol", F.col("shape.k").alias("k"), F.col("shape.centre").alias("centre")).alias("s"))
    packed = own.groupBy("visitor_id").agg(F.map_from_entries(F.collect_list(entry)).alias("by"), F.sum("weight").alias("total"), F.first("preset_index").alias("preset_index"))
    return packed.select("visitor_id", "preset_index", "total", F.transform(F.sequence(F.lit(0), F.lit(len(slots) - 1)), lambda i: F.try_element_at("by", i)).alias("slots"))


def visitor_pairs(places: DataFrame, visitors: DataFrame, n_factors: int, n_layers: int, climate_at: int, blocks: int | None = None, salts: int | None = None) -> DataFrame:
    """visitor_id, geo_id, total, slots, v: the values that a visitor weighs at a place, by slot.

    Visitors (visitor_slots) go in blocks, as one array a block; each place (place_vectors) meets each block once, by an
    equi-join on block and salt, and its rows for the visitors unfold where they are scored. There are as many blocks as
    the visitors fill, VISITOR_BLOCKS at most, so that places do not meet empty ones; fewer blocks have more salts. A
    visitor's preset stands in for the climate factor where the county has preset scores.
    """
    if blocks is None:
        visitors = cut(visitors)
        blocks = max(1, min(VISITOR_BLOCKS, -(-visitors.count() // BLOCK_VISITORS)))
    salts = max(PLACE_SALTS, VISITOR_BLOCKS * PLACE_SALTS // blocks) if salts is None else salts
    block = F.pmod(F.xxhash64("visitor_id"), F.lit(blocks)).cast("int")
    packed = visitors.groupBy(block.alias("block")).agg(F.collect_list(F.struct("visitor_id", "preset_index", "total", "slots")).alias("who"))
    packed = packed.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    each = places.withColumn("salt", F.pmod(F.xxhash64("geo_id"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    met = each.join(packed, ["block", "salt"]).select("geo_id", "f", "cp", "pct", "raw", F.explode("who").alias("x"))
    values = []
    for i in range(n_factors):
        own = F.get("f", F.lit(i))
        if i == climate_at:
            own = F.when(F.col("x.preset_index").isNotNull() & F.col("cp").isNotNull(), F.get("cp", F.col("x.preset_index"))).otherwise(own)
        values.append(own)
    for k in range(n_layers):
        slot = F.get("x.slots", F.lit(n_factors + k))
        values.append(direction_value(slot["direction"], F.get("pct", F.lit(k)), F.get("raw", F.lit(k)), slot["target"], slot["tol"]))
    return met.select("x.visitor_id", "geo_id", "x.total", "x.slots", F.array(*values).alias("v"))


def visitor_vector(pairs: DataFrame, slots: list[str]) -> DataFrame:
    """visitor_id, geo_id, slot, v, weight of the slots a visitor weighs, where the place has a value."""
    rows = pairs.select("visitor_id", "geo_id", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in slots]).alias("slot"), F.col("v"), F.col("slots").alias("s"))).alias("z"))
    return rows.where("z.s is not null and z.v is not null").select("visitor_id", "geo_id", "z.slot", "z.v", F.col("z.s.weight").alias("weight"))


def visitor_scores(pairs: DataFrame, n_slots: int) -> DataFrame:
    """visitor_id, geo_id, score, weight_covered, ok: arithmetic over the slots of a pair, no join and no grouping."""
    held, total = F.lit(0.0), F.lit(0.0)
    for i in range(n_slots):
        slot, v = F.get("slots", F.lit(i)), F.get("v", F.lit(i))
        live = slot.isNotNull() & v.isNotNull()
        held = held + F.when(live, slot["weight"]).otherwise(0.0)
        total = total + F.when(live, slot["weight"] * sc.shaped_log(v, slot["k"], slot["centre"])).otherwise(0.0)
    scored = pairs.select("visitor_id", "geo_id", F.exp(total / F.nullif(held, F.lit(0.0))).alias("score"), (held / F.col("total")).alias("weight_covered"))
    return scored.where(F.col("score").isNotNull()).withColumn("ok", F.col("weight_covered") >= sc.MIN_WEIGHT_COVERED)


def rank_towns(scores: DataFrame, homes: DataFrame) -> DataFrame:
    """Rank and percentile of the covered towns but the home; the home's rank is 1 + those that beat it.

    homes: visitor_id, home.
    """
    ok = scores.where("ok").join(homes, "visitor_id", "left")
    is_home = F.coalesce(F.col("geo_id") == F.col("home"), F.lit(False))
    others = ok.where(~is_home).select("visitor_id", "geo_id", "score")
    ranked = ordinal(others, ["visitor_id"], [-F.col("score"), F.col("geo_id")])
    own = ok.where(is_home).select("visitor_id", "geo_id", "score")
    better = others.join(own.select("visitor_id", F.col("score").alias("hs")), "visitor_id").groupBy("visitor_id").agg(
        F.count_if(F.col("score") > F.col("hs")).alias("b"))
    home = own.join(better, "visitor_id", "left").select("visitor_id", "geo_id", "score", (F.coalesce("b", F.lit(0)) + 1).alias("rank"))
    n = others.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked.unionByName(home).join(n, "visitor_id", "left").withColumn(
        "pct", 1 - (F.col("rank") - 1) / F.greatest(F.lit(1), F.coalesce("n", F.lit(0)) - 1)).drop("n")


def challengers(county_scores: DataFrame, town_scores: DataFrame, towns: DataFrame, visitors: DataFrame, show: int = 8) -> DataFrame:
    """Best counties but the home's, each through its best town (within budget if the visitor asks).

    towns: geo_id, county_geoid, price; visitors: visitor_id, home_county, cap, budget_only.
    """
    over = budget_flag(F.col("price"), F.col("cap")) == "over"
    inside = (
        town_scores.where("ok").select("visitor_id", "geo_id", "score").join(towns, "geo_id").join(visitors, "visitor_id")
        .where(~(F.col("budget_only") & over))
        .groupBy("visitor_id", "county_geoid").agg(F.min(F.struct((-F.col("score")).alias("s"), "geo_id"))["geo_id"].alias("town"))
    )
    counties = county_scores.where("ok").select("visitor_id", F.col("geo_id").alias("county_geoid"), "score")
    field = counties.join(inside, ["visitor_id", "county_geoid"]).join(visitors.select("visitor_id", "home_county"), "visitor_id").where(
        ~F.col("county_geoid").eqNullSafe(F.col("home_county"))).drop("home_county")
    return top_k(field, ["visitor_id"], [F.desc("score"), F.asc("county_geoid")], show, "n")


def towns_within(pins: DataFrame, towns: DataFrame, max_radius: float, grouped: bool = False) -> DataFrame | Grouped:
    """Towns inside each pin's radius. pins: pin, lat, lon, radius; towns: geo_id, lat, lon.

    With `grouped` by groups of towns (spatial.grouped_circles), for what is summed over a pin's towns.
    """
    t = towns.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("geo_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    if grouped:
        return grouped_circles(pins, t, max_radius)
    return within_circles(pins, t, max_radius).select("pin", "geo_id", "miles")


#: Visitors whose ranks travel with a group of towns as one array.
GROUP_VISITORS = 64


def _least_of_groups(near: Grouped, ranked: DataFrame) -> DataFrame:
    """visitor_id, pin, towns, first, first_ok, under: a group of towns has these for each visitor, made once and dealt by
    region as the circles are, so a task adds up what its circles' groups say and a circle leaves it as a row a visitor."""
    who = stored(ordinal(ranked.select("visitor_id").distinct(), [], [F.col("visitor_id")], "v"))
    least = [F.sum("towns").alias("towns"), F.min("first").alias("first"), F.min("first_ok").alias("first_ok"), F.sum("under").alias("under")]
    rows = near.targets.join(ranked.join(who, "visitor_id").select("geo_id", "v", "rank", "fits"), "geo_id").repartition("region")
    spots = rows.groupBy("region", "deepest", "y", "x", "t_lat", "t_lon", "v").agg(
        F.count(F.lit(1)).alias("towns"), F.min("rank").alias("first"), F.min(F.when(F.col("fits"), F.col("rank"))).alias("first_ok"), F.count_if("fits").alias("under"))
    group = ["region", "level", "y", "x", "t_lat", "t_lon"]
    each = groups_of(spots, near.top).groupBy(*group, "v").agg(*least)
    packed = each.groupBy(*group, F.floor(F.col("v") / GROUP_VISITORS).alias("block")).agg(F.collect_list(F.struct("v", "towns", "first", "first_ok", "under")).alias("by"))
    circles = stored(meet(near, packed).select("lat", "lon", "radius", F.inline("by")).groupBy("lat", "lon", "radius", "v").agg(*least))
    # Pins of one circle share its rows; a pin that comes twice counts twice.
    pins = near.points.select("pin", "lat", "lon", "radius").join(circles, ["lat", "lon", "radius"])
    return pins.groupBy("v", "pin").agg(*least).join(who, "v").drop("v")


def pin_summary(near: DataFrame | Grouped, scores: DataFrame, prices: DataFrame, visitors: DataFrame) -> DataFrame:
    """Per visitor and pin: towns, the best, the best under the cap, how many are under it.

    near: the pairs or groups of towns_within. A visitor's towns are ranked once, with the flag of their budget; a pin then
    takes the least rank, a number, and towns near pins meet nothing but these ranks. Pairs grow as pins times towns, and
    each meets every visitor; by groups neither is made.
    """
    flagged = scores.where("ok").select("visitor_id", "geo_id", "score").join(prices, "geo_id", "left").join(visitors.select("visitor_id", "cap"), "visitor_id")
    flagged = stored(flagged.select("visitor_id", "geo_id", "score", F.coalesce(budget_flag(F.col("price"), F.col("cap")) == "ok", F.lit(False)).alias("fits")))
    ranked = stored(ordinal(flagged, ["visitor_id"], [-F.col("score"), F.col("geo_id")]).select("visitor_id", "geo_id", "rank", "fits"))
    if isinstance(near, Grouped):
        least = _least_of_groups(near, ranked)
    else:
        least = near.select("pin", "geo_id").join(ranked, "geo_id").groupBy("visitor_id", "pin").agg(
            F.count(F.lit(1)).alias("towns"), F.min("rank").alias("first"), F.min(F.when(F.col("fits"), F.col("rank"))).alias("first_ok"), F.count_if("fits").alias("under"))
    least = stored(least)
    # Ranks are named once, whichever pins they are the least of.
    named = stored(least.select("visitor_id", F.explode(F.array("first", "first_ok")).alias("rank")).where("rank is not null").distinct().join(ranked, ["visitor_id", "rank"]).select("visitor_id", "rank", "geo_id"))
    name = lambda rank, geo_id: named.select("visitor_id", F.col("rank").alias(rank), F.col("geo_id").alias(geo_id))
    return least.join(name("first", "best"), ["visitor_id", "first"]).join(name("first_ok", "best_ok"), ["visitor_id", "first_ok"], "left").select(
        "visitor_id", "pin", "towns", "best", "best_ok", "under")


#: Letters of a text that its join goes by, and texts that may be sent to every task.
SEARCH_LETTERS, SENT_TEXTS = 16, 200_000


def _pieces(text: Column, sizes: Column) -> Column:
    """The distinct pieces of a text, of each of the sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def place_search(queries: DataFrame, universe: DataFrame, limit: int = 8) -> DataFrame:
    """Names containing the text: those starting with it first, then by population.

    queries: query_id, q. Each text is searched once, whoever asks. It meets the names by an equi-join of its first
    SEARCH_LETTERS letters on the names' pieces of the lengths that texts have, and a longer one is then checked whole, so
    a pair that meets is nearly always a hit. Up to SENT_TEXTS texts go to the names, whose pieces then stay where they are.
    """
    q = queries.withColumn("t", F.lower(F.trim("q"))).where(F.length("t") >= 2)
    label = F.concat_ws(", ", clean_name("name"), "state_usps")
    key = F.lower(F.concat_ws(" ", clean_name("name"), "state_usps"))
    names = universe.select("geo_id", label.alias("label"), key.alias("key"), F.coalesce("population", F.lit(0)).alias("pop"))
    texts = cut(q.select("t").distinct().withColumn("g", F.substring("t", 1, SEARCH_LETTERS)))
    sizes = texts.agg(F.collect_set(F.length("g")).alias("sizes")).withColumn("one", F.lit(1))
    pieces = names.withColumn("one", F.lit(1)).join(F.broadcast(sizes), "one").withColumn("g", F.explode(_pieces("key", F.col("sizes")))).drop("one", "sizes")
    few = texts.limit(SENT_TEXTS + 1).count() <= SENT_TEXTS
    hits = pieces.join(F.broadcast(texts) if few else texts, "g").where(F.contains("key", "t"))
    order = [F.desc(F.startswith("key", "t")), F.desc("pop"), F.asc("geo_id")]
    best = top_k(hits.select("t", "geo_id", "label", "key", "pop"), ["t"], order, limit)
    asked = q.select("query_id", "t").distinct().join(best, "t")
    return top_k(asked, ["query_id"], order, limit, "n").select("query_id", "n", "geo_id", "label")


# ------------------------------------------------------------------------- answers to weights


def largest_remainder(weights: DataFrame, by: str, slot: str = "slot", weight: str = "weight") -> DataFrame:
    """Whole points that sum to 100 per group; zero stays zero, larger remainders round up first.

    A group is one person's handful of slots.
    """
    whole = Window.partitionBy(by)
    w = F.when(F.col("__t") > 0, F.col(weight) * 100 / F.col("__t")).otherwise(F.lit(0.0))
    base = weights.withColumn("__t", F.sum(weight).over(whole)).withColumn("__w", w).withColumn("__f", F.floor("__w"))
    # Slots with nothing cannot round up, so they sort last; remainders are compared to 9 places.
    order = Window.partitionBy(by).orderBy((F.col("__w") > 0).desc(), F.round(F.col("__w") - F.col("__f"), 9).desc(), F.asc(slot))
    ranked = base.withColumn("__short", 100 - F.sum("__f").over(whole)).withColumn("__rn", F.row_number().over(order))
    up = (F.col("__w") > 0) & (F.col("__rn") <= F.col("__short"))
    return ranked.select(by, slot, (F.col("__f") + F.when(up, 1).otherwise(0)).cast("bigint").alias("points"))


def raw_option_weights(people: DataFrame, base: DataFrame, effects: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Weights before rounding: scales multiply defaults, the last share fixes points, the rest fills up.

    people: by; base: slot, default_weight; effects: question, option, kind (scale/share), slot, amount;
    answers: by, question, option, step (order on the path).
    """
    chosen = answers.join(effects, ["question", "option"]).groupBy(by, "slot").agg(
        F.coalesce(F.product(F.when(F.col("kind") == "scale", F.col("amount"))), F.lit(1.0)).alias("scale"),
        F.max_by(F.when(F.col("kind") == "share", F.col("amount")), F.when(F.col("kind") == "share", F.col("step"))).alias("share"))
    # Every person weighs every slot: the slots travel as one small array.
    slots = base.agg(F.collect_list(F.struct("slot", "default_weight")).alias("s")).withColumn("__k", F.lit(1))
    all_slots = people.select(by).withColumn("__k", F.lit(1)).join(slots, "__k").select(by, F.inline("s"))
    w = Window.partitionBy(by)
    scaled = F.col("default_weight") * F.coalesce("scale", F.lit(1.0))
    joined = all_slots.join(chosen, [by, "slot"], "left").withColumn("__free", F.when(F.col("share").isNull(), scaled).otherwise(F.lit(0.0)))
    fixed, free = F.sum(F.coalesce("share", F.lit(0.0))).over(w), F.sum("__free").over(w)
    fill = F.when(free > 0, F.col("__free") * (100 - fixed) / free).otherwise(F.lit(0.0))
    return joined.select(by, "slot", F.coalesce("share", fill).alias("weight"))


def weights_from_options(people, base, effects, answers, by: str) -> DataFrame:
    return largest_remainder(raw_option_weights(people, base, effects, answers, by), by)


CLIMATE_STEPS = (-2, -1, 0, 1, 2)


def nearest_preset(homes: DataFrame, presets: DataFrame) -> DataFrame:
    """The preset whose winter band is centred nearest each home's winter: adds position.

    homes: by columns and winter; presets: position, lo, hi. The first preset wins a tie.
    """
    bands = presets.agg(F.array_sort(F.collect_list(F.struct("position", "lo", "hi"))).alias("p")).withColumn("__k", F.lit(1))
    best = F.array_min(F.transform("p", lambda b: F.struct(F.abs((b["lo"] + b["hi"]) / 2 - F.col("winter")).alias("d"), b["position"].alias("position"))))
    return homes.withColumn("__k", F.lit(1)).join(bands, "__k").withColumn("position", best["position"]).withColumn("last", F.size("p") - 1).drop("p", "__k")


def climate_choices(homes: DataFrame, presets: DataFrame, by: str) -> DataFrame:
    """Steps worth offering: where two land on one preset, the gentler (then the colder) is kept."""
    at = nearest_preset(homes, presets)
    steps = at.select(by, F.explode(F.array(*[F.lit(s) for s in CLIMATE_STEPS])).alias("step"), "position", "last").withColumn(
        "preset_position", F.greatest(F.lit(0), F.least(F.col("last"), F.col("position") + F.col("step"))))
    return steps.groupBy(by, "preset_position").agg(F.min(F.struct(F.abs("step").alias("a"), "step"))["step"].alias("step"))


def blend_couple(each: DataFrame, climates: DataFrame, by: str = "household") -> tuple[DataFrame, DataFrame]:
    """Mean weights of the people who answered, in whole points; the preset halfway, rounding warmer.

    each: household, person, slot, points; climates: household, person, preset_position (null for none).
    """
    mean = each.groupBy(by, "slot").agg(F.avg("points").alias("weight"))
    climate = climates.where(F.col("preset_position").isNotNull()).groupBy(by).agg(F.floor(F.avg("preset_position") + 0.5).cast("int").alias("preset_position"))
    return largest_remainder(mean, by), climate


def settings_upgrade(saved: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Stored weight maps brought to the slots offered now: missing ones filled, retired ones dropped."""
    table = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, float(v))])
    kept = F.map_filter(F.coalesce("weights", F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*defaults))
    missing = F.map_filter(table, lambda k, v: ~F.coalesce(F.map_contains_key(kept, k), F.lit(False)))
    return saved.withColumn("weights", F.map_concat(kept, missing))


# Older answers and what they mean now.
LEGACY_WORK = {"portable": "remote", "partly": "partly", "local": "local"}


def legacy_answers(saved: DataFrame) -> DataFrame:
    """who, kids_future, work and flights from settings saved before the questions existed."""
    now, couple = F.col("kids") == "now", F.col("mode") == "couple"
    who = F.when(F.col("mode").isNull(), None).when(couple, F.when(now, "family").otherwise("couple")).otherwise(F.when(now, "kids").otherwise("solo"))
    kids = F.when(F.col("kids").isNotNull() & ~now, F.when(F.col("kids") == "planned", "yes").otherwise("no"))
    work = F.try_element_at(F.create_map(*[F.lit(x) for p in LEGACY_WORK.items() for x in p]), F.col("income"))
    return saved.select("visitor_id", who.alias("who"), kids.alias("kids_future"), work.alias("work"), F.col("flights"))


def facts_with_fallback(features: DataFrame, places: DataFrame) -> DataFrame:
    """Each indicator's own value for a town, else its county's, with the level it came from."""
    cols = ["geo_id", "indicator_id", "value"]
    own = features.where((F.col("geo_level") == "place") & F.col("value").isNotNull()).join(places.select("geo_id"), "geo_id", "left_semi").select(
        *cols, F.lit("town").alias("from_level"))
    parent = features.where((F.col("geo_level") == "county") & F.col("value").isNotNull()).select(F.col("geo_id").alias("county_geoid"), "indicator_id", "value")
    borrowed = places.select("geo_id", "county_geoid").join(parent, "county_geoid").select(*cols, F.lit("county").alias("from_level"))
    return own.unionByName(borrowed.join(own.select("geo_id", "indicator_id"), ["geo_id", "indicator_id"], "left_anti"))
