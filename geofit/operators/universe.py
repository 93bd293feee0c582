"""The fixed candidate universe and the place-to-county crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.functions.keys import classify_place, in_scope, norm_key, usps_of
from geofit.operators.spatial import nearest_within_state

MIN_PLACE_POPULATION = 5_000
COUNTY_SEPARATOR = "~~~"
UNIVERSE_COLUMNS = (
    "geo_level", "geo_id", "name", "state_usps", "state_fips", "county_geoid", "population",
    "land_sqmi", "lat", "lon", "place_class",
)


def crosswalk_normalise(links: DataFrame) -> DataFrame:
    """Weights as shares of their place; a place whose weights do not add up is split evenly.

    Totals are grouped (partial sums before the shuffle), not windowed.
    """
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    totals = links.groupBy("place_geoid").agg(F.sum(w).alias("__total"), F.count(F.lit(1)).alias("__n"))
    return links.join(totals, "place_geoid").select(
        "place_geoid", "county_geoid",
        F.when(F.col("__total") > 0, w / F.col("__total")).otherwise(1.0 / F.col("__n")).alias("weight"),
    )


def crosswalk_combine(listed: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured population weights where a place has any, its listed counties where it has none."""
    rest = listed.join(measured.select("place_geoid").distinct(), "place_geoid", "left_anti")
    cols = ["place_geoid", "county_geoid", F.col("weight").cast("double").alias("weight")]
    return (
        measured.select(*cols, F.lit("measured").alias("basis"))
        .unionByName(rest.select(*cols, F.lit("even").alias("basis")))
    )


def crosswalk_stats(combined: DataFrame) -> DataFrame:
    return combined.groupBy("basis").agg(F.count_distinct("place_geoid").alias("places"))


def primary_parent(links: DataFrame) -> DataFrame:
    """The county holding the largest share; the smaller id when shares are equal."""
    return links.groupBy("place_geoid").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "county_geoid"))["county_geoid"].alias("county_geoid")
    )


def unmatched_keys(places: DataFrame, links: DataFrame) -> DataFrame:
    """Places with no parent, to be reported."""
    return places.join(links.select("place_geoid").distinct(), "place_geoid", "left_anti")


def county_name_index(counties: DataFrame) -> DataFrame:
    """(state_usps, upper-cased name) -> county; in-scope counties only."""
    geo = norm_key("geoid", 5)
    return counties.where(in_scope(geo)).groupBy(
        "state_usps", F.upper(F.trim("name")).alias("county_name")
    ).agg(F.max(geo).alias("county_geoid"))


def name_index_join(places: DataFrame, index: DataFrame) -> DataFrame:
    """One row per listed county name; county_geoid is null where the name is unknown.

    places: place_geoid, state_usps, counties ('~~~'-separated names).
    """
    named = (
        places.select("place_geoid", "state_usps", F.explode(F.split("counties", COUNTY_SEPARATOR)).alias("n"))
        .withColumn("name", F.trim("n"))
        .where(F.col("name") != "")
        .withColumn("county_name", F.upper("name"))
    )
    return named.join(index, ["state_usps", "county_name"], "left").select(
        "place_geoid", "state_usps", "name", "county_geoid"
    )


def build_counties(gazetteer: DataFrame, population: DataFrame) -> DataFrame:
    """In-scope counties; an unknown population stays null."""
    geo = norm_key("geoid", 5)
    pop = population.select("geo_id", F.col("population").cast("bigint").alias("population"))
    return (
        gazetteer.withColumn("geo_id", geo)
        .where(in_scope("geo_id"))
        .join(pop, "geo_id", "left")
        .select(
            F.lit("county").alias("geo_level"), "geo_id", F.col("name"),
            F.coalesce(F.nullif("usps", F.lit("")), usps_of("geo_id")).alias("state_usps"),
            F.substring("geo_id", 1, 2).alias("state_fips"), F.col("geo_id").alias("county_geoid"),
            "population", F.col("aland_sqmi").try_cast("double").alias("land_sqmi"),
            F.col("intptlat").try_cast("double").alias("lat"), F.col("intptlong").try_cast("double").alias("lon"),
            F.lit(None).cast("string").alias("place_class"),
        )
    )


def place_dispositions(
    gazetteer: DataFrame, population: DataFrame, links: DataFrame, counties: DataFrame | None = None,
    classes: DataFrame | None = None, floor: int = MIN_PLACE_POPULATION,
) -> DataFrame:
    """Every gazetteer place with what happened to it; the kept ones carry their county.

    Tests run in order: scope, population known, population floor, crosswalk, then the nearest
    county centroid in the state for places the crosswalk does not know.
    """
    pop = population.select("geo_id", F.col("population").cast("bigint").alias("population"))
    per_place = primary_parent(links).join(
        links.groupBy("place_geoid").agg(F.count(F.lit(1)).alias("n_links")), "place_geoid"
    ).withColumnRenamed("place_geoid", "geo_id")
    base = (
        gazetteer.select(
            norm_key("geoid", 7).alias("geo_id"), "name", "usps", "lsad",
            F.col("aland_sqmi").try_cast("double").alias("land_sqmi"),
            F.col("intptlat").try_cast("double").alias("lat"), F.col("intptlong").try_cast("double").alias("lon"),
        )
        .join(pop, "geo_id", "left")
        .join(per_place, "geo_id", "left")
    )
    early = (
        F.when(~in_scope("geo_id"), "out_of_scope")
        .when(F.col("population").isNull(), "no_population")
        .when(F.col("population") < floor, "below_floor")
    )
    staged = base.withColumn("early", early)
    if counties is not None:
        lost = staged.where(F.col("early").isNull() & F.col("county_geoid").isNull()).select(
            F.col("geo_id").alias("place_geoid"), "lat", "lon"
        )
        rescued = nearest_within_state(
            lost, counties.select(F.col("geo_id").alias("county_geoid"), "lat", "lon")
        ).select(F.col("place_geoid").alias("geo_id"), F.col("county_geoid").alias("near_geoid"))
        staged = staged.join(rescued, "geo_id", "left")
    else:
        staged = staged.withColumn("near_geoid", F.lit(None).cast("string"))
    by_lsad = classify_place("lsad")
    if classes is not None:
        staged = staged.join(classes.select("geo_id", "place_class"), "geo_id", "left").withColumn(
            "place_class", F.coalesce("place_class", by_lsad)
        )
    else:
        staged = staged.withColumn("place_class", by_lsad)
    return staged.select(
        "geo_id", "name",
        F.coalesce(F.nullif("usps", F.lit("")), usps_of("geo_id")).alias("state_usps"),
        "population", "land_sqmi", "lat", "lon", "place_class", "n_links",
        F.coalesce("county_geoid", F.when(F.col("early").isNull(), F.col("near_geoid"))).alias("county_geoid"),
        F.coalesce(
            "early",
            F.when(F.col("county_geoid").isNotNull(), "kept")
            .when(F.col("near_geoid").isNotNull(), "kept_by_centroid")
            .otherwise("no_county"),
        ).alias("disposition"),
    )


def build_places(dispositions: DataFrame) -> DataFrame:
    return dispositions.where(F.col("disposition").startswith("kept")).select(
        F.lit("place").alias("geo_level"), "geo_id", "name", "state_usps",
        F.substring("geo_id", 1, 2).alias("state_fips"), "county_geoid", "population", "land_sqmi",
        "lat", "lon", "place_class",
    )


def place_links(dispositions: DataFrame, links: DataFrame) -> DataFrame:
    """Link rows of the kept places; a rescued place has one link of weight 1."""
    kept = dispositions.where(F.col("disposition") == "kept").select(F.col("geo_id").alias("place_geoid"))
    rescued = dispositions.where(F.col("disposition") == "kept_by_centroid").select(
        F.col("geo_id").alias("place_geoid"), "county_geoid", F.lit(1.0).alias("weight")
    )
    return links.select("place_geoid", "county_geoid", "weight").join(kept, "place_geoid", "left_semi").unionByName(rescued)


def build_universe(counties: DataFrame, places: DataFrame) -> DataFrame:
    return counties.select(*UNIVERSE_COLUMNS).unionByName(places.select(*UNIVERSE_COLUMNS))


def duplicate_keys(universe: DataFrame) -> DataFrame:
    """Ids that occur more than once; a sound universe has none."""
    return universe.groupBy("geo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def universe_report(counties_raw: DataFrame, counties: DataFrame, dispositions: DataFrame) -> DataFrame:
    """The build's counters as (counter, n) rows."""
    d, n = F.col("disposition"), F.count_if
    kept = d.startswith("kept")
    places = dispositions.agg(
        F.count(F.lit(1)).alias("places_total"),
        n(kept).alias("places_kept"),
        n(d == "below_floor").alias("places_below_floor"),
        n(d == "no_population").alias("places_no_population"),
        n(d == "no_county").alias("places_unmatched_county"),
        n((d == "kept") & (F.col("n_links") > 1)).alias("places_multi_county"),
        n(d == "kept_by_centroid").alias("places_county_by_centroid"),
        n(kept & (F.col("place_class") == "incorporated")).alias("incorporated"),
        n(kept & (F.col("place_class") == "cdp")).alias("cdp"),
        n(d == "out_of_scope").alias("places_out_of_scope"),
    )
    names = places.columns
    out = places.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in names])))
    kept_counties = counties.agg(F.count(F.lit(1)).alias("n")).select(F.lit("counties").alias("counter"), "n")
    outside = counties_raw.agg(n(~in_scope(norm_key("geoid", 5))).alias("n")).select(
        F.lit("counties_out_of_scope").alias("counter"), "n"
    )
    return out.unionByName(kept_counties).unionByName(outside)


def population_union(*frames: DataFrame) -> DataFrame:
    """Populations from several sources; a later frame wins where a key repeats."""
    tagged = [
        f.select("geo_id", F.col("population").cast("bigint").alias("population"), F.lit(i).alias("__o"))
        for i, f in enumerate(frames)
    ]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return out.groupBy("geo_id").agg(F.max_by("population", "__o").alias("population"))
