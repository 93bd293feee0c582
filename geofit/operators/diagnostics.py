"""Is the ranking telling the reader anything? Popularity, sensitivity, leaks, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofit.functions.curves import desirability
from geofit.functions.keys import county_key, match_stem
from geofit.functions.units import format_value
from geofit.operators.lineage import cut
from geofit.operators.ordering import HEAVY_VALUES, average_rank, exact_quantiles, top_k
from geofit.operators.registry import Profiles
from geofit.operators.scoring import ranking, score
from geofit.sources.normalise import num, with_newest

# ------------------------------------------------------------------------- popularity

MIN_POPULATION = 1_000
SHRINK = 50_000


def appreciation(series: DataFrame, years: int = 5) -> DataFrame:
    """Price change from `years` before the newest month to it, of series (statecodefips, municipalcodefips, month, value);
    a county must have both months."""
    v = num("value")
    on = lambda day: F.max(F.when(F.col("at") == day, v))
    keyed = with_newest(series).withColumn("geo_id", county_key("statecodefips", "municipalcodefips")).where(F.col("geo_id").isNotNull())
    both = keyed.groupBy("geo_id").agg(on(F.col("newest")).alias("now"), on(F.add_months("newest", -12 * years)).alias("then"))
    return both.where((F.col("then") > 0) & F.col("now").isNotNull()).select("geo_id", ((F.col("now") - F.col("then")) / F.col("then")).alias("appreciation"))


def hype_index(universe: DataFrame, migration: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean of two percentiles (average rank / n): shrunk net migration and appreciation.

    A county needs 1,000 people and both figures.
    """
    pop, net = F.col("population"), F.col("net_migration")
    base = (
        universe.where((F.col("geo_level") == "county") & (pop >= MIN_POPULATION))
        .select("geo_id", "name", "state_usps", "population")
        .join(migration, "geo_id").join(prices, "geo_id")
        .withColumn("migration_rate", 1000 * net / pop)
        .withColumn("migration_shrunk", 1000 * net / (pop + SHRINK))
        .where(F.col("migration_shrunk").isNotNull() & F.col("appreciation").isNotNull())
    )
    base = cut(base)
    pct = lambda df, c, name: average_rank(df, [], c).withColumn(name, F.col("avg_rank") / F.col("n")).drop("avg_rank", "n")
    both = pct(pct(base, "migration_shrunk", "p_migration"), "appreciation", "p_appreciation")
    return both.withColumn("hype", (F.col("p_migration") + F.col("p_appreciation")) / 2)


MIN_OVERLAP = 30


def hype_regression(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Fit on hype per profile: slope, intercept, r, r2; null under 30 shared counties."""
    both = index.select("geo_id", "hype").join(scores.select("profile_id", "geo_id", "score"), "geo_id")
    fit = both.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("score", "hype").alias("slope"),
        F.regr_intercept("score", "hype").alias("intercept"), F.corr("hype", "score").alias("r"))
    enough = F.col("n") >= MIN_OVERLAP
    return fit.select("profile_id", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r")],
                      F.when(enough, F.col("r") * F.col("r")).alias("r_squared"))


def hype_residuals(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Each county's score against what its popularity predicts."""
    fit = hype_regression(index, scores).where(F.col("slope").isNotNull())
    expected = F.col("slope") * F.col("hype") + F.col("intercept")
    return (
        index.join(scores.select("profile_id", "geo_id", "score"), "geo_id").join(fit, "profile_id")
        .select("profile_id", "geo_id", "name", "hype", "score", expected.alias("fit_expected_from_hype"),
                (F.col("score") - expected).alias("residual"))
    )


def quiet_winners(index: DataFrame, scores: DataFrame, show: int = 15) -> DataFrame:
    """Top decile of fit, lower half of popularity."""
    both = index.select("geo_id", "name", "hype").join(scores.select("profile_id", "geo_id", "score"), "geo_id")
    cuts = exact_quantiles(both, ["profile_id"], "score", {"cut": 0.9})
    picked = both.join(cuts, "profile_id").where((F.col("score") >= F.col("cut")) & (F.col("hype") < 0.5)).drop("cut")
    return top_k(picked, ["profile_id"], [F.desc("score"), F.asc("geo_id")], show)


def loud_losers(index: DataFrame, scores: DataFrame, show: int = 15) -> DataFrame:
    """Top decile of popularity, below the median fit."""
    both = index.select("geo_id", "name", "hype").join(scores.select("profile_id", "geo_id", "score"), "geo_id")
    cuts = exact_quantiles(both, ["profile_id"], "hype", {"cut": 0.9}).join(
        exact_quantiles(both, ["profile_id"], "score", {"mid": 0.5}), "profile_id")
    picked = both.join(cuts, "profile_id").where((F.col("hype") >= F.col("cut")) & (F.col("score") < F.col("mid"))).drop("cut", "mid")
    return top_k(picked, ["profile_id"], [F.desc("hype"), F.asc("geo_id")], show)


# ------------------------------------------------------------------------- with and without


def _tag(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn("profile_id", F.concat("profile_id", F.lit("|" + tag)))


def _untagged() -> Column:
    """The profile's own id, which may hold the mark itself: only the last one was put there."""
    return F.regexp_replace("profile_id", r"\|(on|off)$", "")


def _side() -> Column:
    return F.substring_index("profile_id", "|", -1)


def with_and_without(profiles: Profiles, domains: list[str]) -> Profiles:
    """Each profile twice: as it is (|on), and without the domains' weight and opt-ins (|off)."""
    both = lambda df: _tag(df, "on").unionByName(_tag(df, "off"))
    return Profiles(
        _tag(profiles.domain_weights, "on").unionByName(_tag(profiles.domain_weights.where(~F.col("domain").isin(*domains)), "off")),
        both(profiles.indicator_weights), both(profiles.overrides), _tag(profiles.opt_ins, "on"), both(profiles.knockouts))


def rank_delta(ranked: DataFrame) -> DataFrame:
    """rank_on, rank_off and the change (positive: helped by the layer) per profile and place."""
    side = lambda tag: ranked.where(_side() == tag).select(
        _untagged().alias("profile_id"), "geo_id",
        F.col("rank").alias(f"rank_{tag}"), F.col("score").alias(f"score_{tag}"))
    return side("on").join(side("off"), ["profile_id", "geo_id"]).withColumn("rank_change", F.col("rank_off") - F.col("rank_on"))


def layer_ranks(features: DataFrame, registry: DataFrame, profiles: Profiles, domains: list[str]) -> DataFrame:
    """Rankings of both versions of every profile, scored in one job."""
    return cut(ranking(score(features, registry, with_and_without(profiles, domains))))


def top_changes(ranked: DataFrame, top: int = 25) -> DataFrame:
    """Places that entered or left the top when the layer was switched on."""
    head = ranked.where(F.col("rank") <= top).select(
        _untagged().alias("profile_id"), _side().alias("side"), "geo_id")
    on, off = (head.where(F.col("side") == s).drop("side") for s in ("on", "off"))
    key = ["profile_id", "geo_id"]
    return on.join(off, key, "left_anti").withColumn("change", F.lit("entered")).unionByName(
        off.join(on, key, "left_anti").withColumn("change", F.lit("left")))


def biggest_movers(delta: DataFrame, each: int = 8) -> DataFrame:
    """The largest changes up and down per profile, once each."""
    up = top_k(delta, ["profile_id"], [F.desc("rank_change"), F.asc("geo_id")], each)
    down = top_k(delta, ["profile_id"], [F.asc("rank_change"), F.asc("geo_id")], each)
    return up.unionByName(down).dropDuplicates(["profile_id", "geo_id"])


def counter_axis(features, registry, profiles, without_scores: DataFrame, show: int = 12) -> DataFrame:
    """Good places on the other side of the median from each opted-in ideal.

    without_scores: scores with the sensitive layer off. The ideal is the target of a point
    curve, else the low end of a band.
    """
    over = profiles.overrides.select("profile_id", "indicator_id", F.col("params").alias("o"))
    p = F.coalesce("o", "params")
    ideals = (
        profiles.opt_ins.join(registry.select("indicator_id", "params"), "indicator_id")
        .join(over, ["profile_id", "indicator_id"], "left")
        .select("profile_id", "indicator_id", F.coalesce(p["target"], p["lo"]).alias("ideal"))
        .where(F.col("ideal").isNotNull())
    )
    values = features.where(F.col("value").isNotNull()).join(ideals.select("indicator_id").distinct(), "indicator_id", "left_semi").select(
        "geo_id", "indicator_id", "value")
    medians = exact_quantiles(values, ["indicator_id"], "value", {"median": 0.5})
    far = F.when(F.col("ideal") <= F.col("median"), F.col("value") > F.col("median")).otherwise(F.col("value") < F.col("median"))
    rows = (
        ideals.join(medians, "indicator_id").join(values, "indicator_id").where(far)
        .join(without_scores.select("profile_id", "geo_id", "score"), ["profile_id", "geo_id"])
        .select("profile_id", "indicator_id", "geo_id", "value", "score")
    )
    return top_k(rows, ["profile_id", "indicator_id"], [F.desc("score"), F.asc("geo_id")], show)


def near_complete(features: DataFrame, universe: DataFrame, registry: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Registry entries whose indicator has a value for almost every place at its level."""
    places = universe.groupBy("geo_level").agg(F.count(F.lit(1)).alias("n"))
    have = features.where(F.col("value").isNotNull()).groupBy("geo_level", "indicator_id").agg(F.count(F.lit(1)).alias("have"))
    full = have.join(places, "geo_level").where(F.col("have") / F.col("n") >= threshold)
    return registry.join(full.select("indicator_id"), "indicator_id", "left_semi")


def complete_only_delta(features, universe, registry, profiles, threshold: float = 0.95) -> DataFrame:
    """Ranks on every indicator against ranks on the nearly complete ones only."""
    rank = lambda reg, tag: _tag(cut(ranking(score(features, reg, profiles))), tag)
    everything = rank(registry, "on")
    complete = rank(cut(near_complete(features, universe, registry, threshold)), "off")
    return rank_delta(everything.unionByName(complete))


# ------------------------------------------------------------------------- blind export and leaks


def blind_labels(shortlist: DataFrame) -> DataFrame:
    """Place A, Place B, ... by position; numbers past the alphabet."""
    n = F.col("position")
    return shortlist.withColumn("label", F.concat(F.lit("Place "), F.when(n <= 26, F.char(64 + n)).otherwise(n.cast("string"))))


def blind_export(shortlist: DataFrame, features: DataFrame, universe: DataFrame, registry: DataFrame, indicators: list[str]) -> DataFrame:
    """Anonymous profiles of a shortlist (geo_id, position): only allow-listed indicators, gaps shown as gaps."""
    labelled = blind_labels(shortlist)
    wanted = registry.where(F.col("indicator_id").isin(*indicators)).select("indicator_id", F.col("label").alias("i_label"), "unit")
    slots = labelled.select("geo_id", "label", F.explode(F.array(*[F.lit(i) for i in indicators])).alias("indicator_id")).join(wanted, "indicator_id")
    values = features.where(F.col("indicator_id").isin(*indicators)).select("geo_id", "indicator_id", "value")
    shown = slots.join(values, ["geo_id", "indicator_id"], "left").groupBy("geo_id", "label").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("i_label", format_value("value", "unit"))))).alias("values"))
    return shown.join(universe.select("geo_id", "population"), "geo_id", "left").select("label", "population", "values")


def blind_key(shortlist: DataFrame, universe: DataFrame) -> DataFrame:
    """The sealed key, kept in a table of its own."""
    names = universe.select("geo_id", F.concat_ws(", ", "name", "state_usps").alias("name"))
    return blind_labels(shortlist).join(names, "geo_id", "left").select("label", F.coalesce("name", "geo_id").alias("name"))


WORD = r"\p{L}\p{N}_"
MIN_STEM = 5


def _words(c) -> Column:
    return F.filter(F.split(c, f"[^{WORD}]+"), lambda t: t != "")


#: Names, codes and ids that are shipped to the tasks as one trie, in bytes; more are met by a join.
TRIE_BYTES = 32 << 20


def leak_scan(texts: DataFrame, universe: DataFrame, numbers: DataFrame | None = None, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Anything in the texts that gives a place away: doc_id, kind, key.

    texts: doc_id, text. A hit counts if the name itself, punctuation included, stands in the text as whole words. The
    names' words make a trie, which each text is read against once; the result's `distinct` is the only exchange. Where
    the universe is too large to ship, runs of words meet the names in a join instead. numbers (doc_id, value) finds ids
    stored as numbers.
    """
    keys = universe.select(
        F.when(F.length(match_stem("name")) >= MIN_STEM, match_stem("name")).alias("stem"), F.nullif("state_usps", F.lit("")).alias("code"), F.col("geo_id").alias("id"))
    kinds = keys.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("stem", "code", "id")]))).where("key is not null").distinct()
    size = kinds.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    if size > trie_bytes:
        return _leaks_by_join(texts, universe, numbers)
    held: dict[str, list[str]] = {"stem": [], "code": [], "id": []}
    for r in kinds.collect():
        held[r["kind"]].append(r["key"])
    shipped = texts.sparkSession.sparkContext.broadcast(held)
    out = texts.select("doc_id", "text").mapInArrow(_trie_reader(shipped), "doc_id " + texts.schema["doc_id"].dataType.simpleString() + ", kind string, key string")
    if numbers is not None:
        as_number = kinds.where("kind = 'id'").select(F.col("key").try_cast("double").alias("value"), "key").where("value is not null")
        out = out.unionByName(numbers.select("doc_id", "value").join(as_number, "value").select("doc_id", F.lit("id").alias("kind"), "key"))
    return out.distinct()


def _trie_reader(shipped):
    """A task's work: all names, codes and ids of the broadcast that stand in each text."""
    def read(batches):
        import pyarrow as pa
        import regex

        word = regex.compile(r"[\p{L}\p{N}_]+")
        root: dict = {}
        for stem in shipped.value["stem"]:
            places = [m.span() for m in word.finditer(stem)]
            node = root
            for a, b in places:
                node = node.setdefault(stem[a:b], {})
            if places:
                node.setdefault(None, []).append((stem, places[0][0]))
        codes, ids = set(shipped.value["code"]), set(shipped.value["id"])
        is_word = lambda text, at: 0 <= at < len(text) and word.match(text[at]) is not None
        for batch in batches:
            docs, kinds, keys = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = set()
                spans = [m.span() for m in word.finditer(text or "")]
                words = [text[a:b] for a, b in spans]
                for i, w in enumerate(words):
                    if w in codes:
                        found.add(("state code", w))
                    if 5 <= len(w) <= 10 and w.isascii() and w.isdigit() and w in ids:
                        found.add(("id", w))
                    node, j = root.get(w), i + 1
                    while node is not None:
                        for stem, lead in node.get(None, ()):
                            at = spans[i][0] - lead
                            if at >= 0 and text.startswith(stem, at) and not is_word(text, at - 1) and not is_word(text, at + len(stem)):
                                found.add(("place name", stem))
                        node, j = node.get(words[j]) if j < len(words) else None, j + 1
                for kind, key in found:
                    docs.append(row)
                    kinds.append(kind)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], names=["doc_id", "kind", "key"])

    return read


def _leaks_by_join(texts: DataFrame, universe: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """leak_scan for a universe of any size: runs of words meet the names in an equi-join."""
    stems = universe.select(match_stem("name").alias("stem")).where(F.length("stem") >= MIN_STEM).distinct().withColumn("w", _words("stem"))
    stems = stems.select("stem", F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).where("n > 0")
    # How many words the names have (a handful of lengths) decides which runs of words to form.
    lengths = stems.agg(F.array_sort(F.collect_set("n")).alias("n")).first()["n"]
    words = texts.select("doc_id", _words("text").alias("w"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    grams = F.flatten(F.array(*[runs(n) for n in (lengths or [1])]))
    candidates = words.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).join(stems.select("stem", "gram"), "gram")
    pattern = F.concat(F.lit(f"(?<![{WORD}])\\Q"), "stem", F.lit(f"\\E(?![{WORD}])"))
    names = candidates.select("doc_id", "stem").join(texts.select("doc_id", "text"), "doc_id").where(
        F.regexp_like("text", pattern)).select("doc_id", F.lit("place name").alias("kind"), F.col("stem").alias("key"))
    tokens = words.select("doc_id", F.explode(F.array_distinct("w")).alias("t"))
    codes = universe.select(F.col("state_usps").alias("t")).where("t <> ''").distinct()
    by_code = tokens.join(codes, "t").select("doc_id", F.lit("state code").alias("kind"), F.col("t").alias("key"))
    ids = universe.select(F.col("geo_id").alias("t")).distinct()
    by_id = tokens.where(F.col("t").rlike("^[0-9]{5,10}$")).join(ids, "t").select("doc_id", F.lit("id").alias("kind"), F.col("t").alias("key"))
    out = names.unionByName(by_code).unionByName(by_id)
    if numbers is not None:
        as_number = ids.select(F.col("t").try_cast("double").alias("value"), F.col("t").alias("key")).where("value is not null")
        out = out.unionByName(numbers.select("doc_id", "value").distinct().join(as_number, "value").select("doc_id", F.lit("id").alias("kind"), "key"))
    return out.distinct()


# ------------------------------------------------------------------------- calibration


#: Groups of at most so many rows are ranked whole, by one shuffle on the group.
WHOLE_ROWS = 100_000


def spearman(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation per group; null under three pairs or when a side does not vary.

    Groups of up to WHOLE_ROWS rows are ranked by windows that hold them; larger ones are cut into buckets. Rows without
    a group are counted and have no ranks.
    """
    large = cut(pairs.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE_ROWS).select(by))
    held = large.count()
    large = F.broadcast(large) if held <= HEAVY_VALUES else large
    small = pairs.where(F.col(by).isNotNull()).select(by, a, b)
    small = small.join(large, by, "left_anti") if held else small

    def rank(value):
        w = Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last())
        upto = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return F.when(F.col(value).isNotNull(), (F.rank().over(w) + upto) / 2)

    ranked = small.withColumn("__ra", rank(a)).withColumn("__rb", rank(b)).select(by, "__ra", "__rb")
    if held:
        rest = pairs.select(by, a, b).join(large, by, "left_semi")
        rest = average_rank(rest, [by], a).withColumnRenamed("avg_rank", "__ra").drop("n")
        rest = average_rank(rest, [by], b).withColumnRenamed("avg_rank", "__rb").drop("n")
        ranked = ranked.unionByName(rest.select(by, "__ra", "__rb"))
    none = F.lit(None).cast("double")
    ranked = ranked.unionByName(pairs.where(F.col(by).isNull()).select(by, none.alias("__ra"), none.alias("__rb")))
    varies = (F.stddev_pop("__ra") > 0) & (F.stddev_pop("__rb") > 0)
    # As corr, which an ANSI session ends with a division by zero where a side does not vary.
    paired = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    rho = F.try_divide(F.covar_pop("__ra", "__rb"), paired("__ra", "__rb") * paired("__rb", "__ra"))
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 3) & varies, rho).alias("rho"))


def calibration_score(features: DataFrame, registry: DataFrame, weights: DataFrame, by: str = "profile_id") -> DataFrame:
    """Weighted arithmetic mean of desirability on the registry's own curves."""
    judged = (
        features.where(F.col("value").isNotNull())
        .join(registry.select("indicator_id", "domain", "curve", "params"), "indicator_id")
        .select("geo_id", "domain", desirability().alias("d")).where(F.col("d").isNotNull())
        # Profiles differ only in domain weights, so a domain's rows are summed before they meet them.
        .groupBy("geo_id", "domain").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    )
    w = F.col("weight")
    return judged.join(weights.where(w > 0), "domain").groupBy(by, "geo_id").agg(
        (F.sum(w * F.col("d")) / F.sum(w * F.col("n"))).alias("score"))


def calibration_pairs(ratings: DataFrame, scores: DataFrame, by: str = "profile_id") -> DataFrame:
    return ratings.select(by, "geo_id", "rating").join(scores.select(by, "geo_id", "score"), [by, "geo_id"])


def calibration(pairs: DataFrame, by: str = "profile_id") -> DataFrame:
    """Correlation and verdict per person; why there is none when there is none."""
    rho = F.col("rho")
    spread = pairs.groupBy(by).agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    return spearman(pairs, by, "rating", "score").join(spread, by).select(
        by, "n", "rho",
        F.when(F.col("n") < 3, "too few rated places")
        .when(rho.isNull() & (F.col("lo") == F.col("hi")), "every rating is the same")
        .when(rho.isNull(), "scores do not vary")
        .when(rho >= 0.6, "reproduces judgements").when(rho >= 0.3, "partial agreement")
        .otherwise("does not reproduce judgements").alias("verdict"))


def calibration_misses(pairs: DataFrame, by: str = "profile_id", show: int = 5) -> DataFrame:
    """The places the model ranks most differently from the person.

    A person rates a questionnaire's worth of places, so a person's ranks are a small window.
    """
    place = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), F.asc("geo_id")))
    ranked = pairs.withColumn("rating_rank", place("rating")).withColumn("model_rank", place("score"))
    gap = F.abs(F.col("rating_rank") - F.col("model_rank"))
    return top_k(ranked.withColumn("gap", gap), [by], [F.desc("gap"), F.asc("geo_id")], show)


# ------------------------------------------------------------------------- coverage and audit


def populated(features: DataFrame) -> DataFrame:
    return features.where(F.col("value").isNotNull()).select("indicator_id").distinct()


def coverage_by_domain(registry: DataFrame, domains: DataFrame, features: DataFrame) -> DataFrame:
    have = populated(features).withColumn("__has", F.lit(True))
    per = registry.join(have, "indicator_id", "left").groupBy("domain").agg(
        F.count(F.lit(1)).alias("registered"), F.count("__has").alias("populated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return domains.where("scoring").select("domain", "label").join(per, "domain", "left").select(
        "domain", "label", zero("registered").alias("registered"), zero("populated").alias("populated"),
        (zero("registered") - zero("populated")).alias("missing"))


def unpopulated_reasons(registry: DataFrame, features: DataFrame, blockers: DataFrame) -> DataFrame:
    """Indicators without data and the known reason (blockers: source, reason)."""
    return registry.join(populated(features), "indicator_id", "left_anti").join(blockers, "source", "left").select(
        "indicator_id", "domain", "source", F.coalesce("reason", F.lit("not yet attempted")).alias("reason"))


def substitutes(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("quality") == "substitute").select("indicator_id", "domain")


def coverage_by_level(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("geo_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean_coverage"), F.count_if(F.col("coverage") < 0.25).alias("below_25"))


def audit(universe, features, manifest, registry, domains, profiles: Profiles, tasks, scores, published) -> DataFrame:
    """Ten principle checks as (principle, verdict, evidence); each can fail on the tables given."""
    n = lambda df, cond: df.agg(F.count_if(cond).alias("bad"), F.count(F.lit(1)).alias("n"))

    def row(no, name, counted, evidence="%d faults in %d rows"):
        return counted.select(F.lit(no).alias("principle"), F.lit(name).alias("name"),
                              F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("verdict"),
                              F.format_string(evidence, "bad", "n").alias("evidence"))

    dup = universe.groupBy("geo_id").agg(F.count(F.lit(1)).alias("c"))
    level = features.join(registry.select("indicator_id", F.col("geo_level").alias("r_level")), "indicator_id", "left")
    traced = features.select("source_file").distinct().join(
        manifest.select(F.col("path").alias("source_file"), "sha256"), "source_file", "left")
    sums = profiles.domain_weights.groupBy("profile_id").agg(F.sum("weight").alias("t"))
    opted = profiles.opt_ins.join(registry.select("indicator_id", "sensitive"), "indicator_id", "left")
    gate = domains.select((F.col("sensitive") & (F.col("default_weight") != 0)).alias("b")).unionByName(
        opted.select((~F.coalesce("sensitive", F.lit(False))).alias("b")))
    asked = registry.join(tasks.select("indicator_id").distinct(), "indicator_id", "left_semi")
    checks = [
        row(1, "universe fixed before preferences", n(dup, F.col("c") > 1)),
        row(2, "identical indicators for every place", n(level, ~F.col("geo_level").eqNullSafe(F.col("r_level")))),
        row(3, "every number traces to a source", n(traced, F.col("sha256").isNull())),
        row(4, "no fabricated input", n(manifest, F.col("synthetic"))),
        row(5, "only manifested files feed features", n(traced, F.col("source_file").isNull())),
        row(6, "missing stays missing", n(features, F.col("value").isNull() & F.col("percentile").isNotNull())),
        row(7, "forced trade-offs leave out sensitive attributes", n(asked, F.col("sensitive"))),
        row(8, "every profile is scored on its own", n(sums.join(scores.select("profile_id").distinct().withColumn("__s", F.lit(1)), "profile_id", "left"), F.col("__s").isNull())),
        row(9, "every published rank has a band", n(published, F.col("rank_p05").isNull() | F.col("rank_p95").isNull())),
        row(10, "sensitive weighs nothing unless chosen", n(gate, F.col("b"))),
    ]
    return reduce(DataFrame.unionByName, checks)
