"""Universe and crosswalk operators over the driver's tables.

Roles: supplier is the coarse unit (county), customer the fine one (place), nation the state;
order value is population and the sales between a customer and a supplier are their overlap.

Keys have fixed widths, rows have not: suppliers of a nation whose numbers end in the same three digits are one county,
customers of a nation whose numbers end in the same five digits one place. Populations, sales and line sums add up, and a
unit's balance is the mean of all its rows, in whole cents. The least number gives the name, the coordinates and the segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.functions import keys
from geofit.functions.geo import haversine_miles
from geofit.operators import features as feat
from geofit.operators import spatial, universe as uni
from geofit.plans.catalog import cte, query, r6, table
from geofit.sources import readers

# ------------------------------------------------------------------------- raw frames


def coords(df, key, a, b, bad):
    """Coordinates as text from a key; every `bad`-th is unreadable."""
    k = F.col(key)
    lat = F.round(25 + (k * a % 2400) / 100, 2).cast("string")
    lon = F.round(-124 + (k * b % 5700) / 100, 2).cast("string")
    return df.withColumn("intptlat", F.when(k % bad == bad - 1, F.lit("n/a")).otherwise(lat)).withColumn(
        "intptlong", F.when(k % bad == bad - 1, F.lit("n/a")).otherwise(lon)
    )


def county_code(nation="s_nationkey", number="s_suppkey"):
    return ((F.col(nation) + 1) * 1000 + F.col(number) % 1000).cast("string")


def place_code(nation="c_nationkey", number="c_custkey"):
    return ((F.col(nation) + 1) * 100000 + F.col(number) % 100000).cast("string")


def mean_balance(balance):
    """Of all rows of a unit; cents add up without rounding."""
    return (F.sum(F.round(F.col(balance) * 100).cast("bigint")) / F.count(balance) / 100).alias(balance)


def county_rows(spark, sf):
    """Each county: the number, name and place of its first supplier, the mean balance of all."""
    s = table(spark, sf, "supplier")
    return s.groupBy("s_nationkey", (F.col("s_suppkey") % 1000).alias("code")).agg(
        F.min("s_suppkey").alias("s_suppkey"), F.min_by("s_name", "s_suppkey").alias("s_name"), mean_balance("s_acctbal")).drop("code")


def place_rows(spark, sf):
    """Each place: the number, name and segment of its first customer, the mean balance of all."""
    c = table(spark, sf, "customer")
    return c.groupBy("c_nationkey", (F.col("c_custkey") % 100000).alias("code")).agg(
        F.min("c_custkey").alias("c_custkey"), F.min_by("c_name", "c_custkey").alias("c_name"), F.min_by("c_mktsegment", "c_custkey").alias("c_mktsegment"), mean_balance("c_acctbal")).drop("code")


def gaz_counties(spark, sf):
    s = county_rows(spark, sf)
    return coords(s, "s_suppkey", 37, 53, 17).select(
        county_code().alias("geoid"),
        F.col("s_name").alias("name"), F.lit("").alias("usps"),
        F.abs("s_acctbal").cast("string").alias("aland_sqmi"), "intptlat", "intptlong",
    )


def gaz_places(spark, sf):
    c = place_rows(spark, sf)
    return coords(c, "c_custkey", 29, 41, 13).select(
        place_code().alias("geoid"),
        F.col("c_name").alias("name"), F.lit("").alias("usps"),
        F.when(F.col("c_mktsegment") == "BUILDING", " 57 ").otherwise("25").alias("lsad"),
        F.abs("c_acctbal").cast("string").alias("aland_sqmi"), "intptlat", "intptlong",
    )


def place_population(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spend = o.groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return c.join(spend, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.lpad(place_code(), 7, "0").alias("geo_id")).agg(
        F.sum("cents").alias("cents")).select("geo_id", F.expr("cents div 50000").alias("population"))


def county_population(spark, sf):
    s, li = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    qty = li.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    counted = s.join(qty, F.col("s_suppkey") == F.col("l_suppkey")).where(F.col("s_suppkey") % 9 != 5)
    return counted.groupBy(F.lpad(county_code(), 5, "0").alias("geo_id")).agg(F.sum("q").alias("population"))


def raw_links(spark, sf):
    """Sales between a customer and the suppliers of its own nation."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    sales = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .groupBy(F.lpad(place_code(), 7, "0").alias("place_geoid"), F.lpad(county_code(), 5, "0").alias("county_geoid"))
        .agg(F.sum("l_quantity").alias("weight"))
    )
    return sales.join(place_rows(spark, sf).select(F.lpad(place_code(), 7, "0").alias("place_geoid"), "c_mktsegment"), "place_geoid")


def combined_links(spark, sf):
    raw = raw_links(spark, sf)
    measured = raw.where("c_mktsegment <> 'HOUSEHOLD'")
    return uni.crosswalk_combine(raw.withColumn("weight", F.lit(0.0)), measured)


def links(spark, sf):
    return uni.crosswalk_normalise(combined_links(spark, sf))


def counties(spark, sf):
    return uni.build_counties(gaz_counties(spark, sf), county_population(spark, sf))


def dispositions(spark, sf):
    return uni.place_dispositions(
        gaz_places(spark, sf), place_population(spark, sf), links(spark, sf), counties(spark, sf)
    )


def full_universe(spark, sf):
    return uni.build_universe(counties(spark, sf), uni.build_places(dispositions(spark, sf)))


# ------------------------------------------------------------------------- SQL twins

STATE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in keys.STATE_USPS.items())
cte("states", f"SELECT * FROM (VALUES {STATE_VALUES}) AS t(code, usps)")
MEAN_BALANCE = "sum(CAST(round({0} * 100) AS BIGINT)) / count({0}) / 100 AS {0}"
cte("sup1", f"SELECT s_nationkey, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name, {MEAN_BALANCE.format('s_acctbal')} FROM supplier GROUP BY s_nationkey, s_suppkey % 1000")
cte("cus1", f"""
SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, {MEAN_BALANCE.format('c_acctbal')}
FROM customer GROUP BY c_nationkey, c_custkey % 100000""")
cte("gaz_c", """
SELECT lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id, s_name AS name, s_suppkey AS k,
  abs(s_acctbal) AS land_sqmi,
  CASE WHEN s_suppkey % 17 <> 16 THEN round(25 + (s_suppkey * 37 % 2400) / 100.0, 2)::DOUBLE END AS lat,
  CASE WHEN s_suppkey % 17 <> 16 THEN round(-124 + (s_suppkey * 53 % 5700) / 100.0, 2)::DOUBLE END AS lon
FROM sup1""")
cte("gaz_p", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS geo_id, c_name AS name, c_custkey AS k,
  abs(c_acctbal) AS land_sqmi, c_mktsegment AS seg,
  CASE WHEN c_custkey % 13 <> 12 THEN round(25 + (c_custkey * 29 % 2400) / 100.0, 2)::DOUBLE END AS lat,
  CASE WHEN c_custkey % 13 <> 12 THEN round(-124 + (c_custkey * 41 % 5700) / 100.0, 2)::DOUBLE END AS lon
FROM cus1""")
cte("pop_p", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS geo_id,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 50000 AS BIGINT) AS population
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
cte("pop_c", """
SELECT lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS population
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 9 <> 5 GROUP BY 1""")
cte("pc_sales", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS place_geoid,
  lpad(CAST((c_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS county_geoid, sum(l_quantity) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
GROUP BY 1, 2""")
cte("raw_links", "SELECT place_geoid, county_geoid, seg AS c_mktsegment, weight FROM pc_sales JOIN gaz_p ON geo_id = place_geoid")
cte("both_links", """
SELECT place_geoid, county_geoid, weight, 'measured' AS basis FROM raw_links WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL SELECT place_geoid, county_geoid, 0.0, 'even' FROM raw_links WHERE c_mktsegment = 'HOUSEHOLD'""")
cte("shares", """
SELECT place_geoid, county_geoid, CASE WHEN sum(weight) OVER p > 0 THEN weight / sum(weight) OVER p
  ELSE 1.0::DOUBLE / count(*) OVER p END AS weight FROM both_links WINDOW p AS (PARTITION BY place_geoid)""")
cte("primary_c", """
SELECT place_geoid, county_geoid FROM shares
QUALIFY row_number() OVER (PARTITION BY place_geoid ORDER BY weight DESC, county_geoid) = 1""")
cte("cty", """
SELECT 'county' AS geo_level, g.geo_id, g.name, s.usps AS state_usps, s.code AS state_fips, g.geo_id AS county_geoid,
  p.population, g.land_sqmi, g.lat, g.lon, CAST(NULL AS VARCHAR) AS place_class
FROM gaz_c g JOIN states s ON substr(g.geo_id, 1, 2) = s.code LEFT JOIN pop_c p ON p.geo_id = g.geo_id""")


def hav(a_lat, a_lon, b_lat, b_lon):
    return (
        f"2 * 3958.7613 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + "
        f"cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2)))))"
    )


cte("staged", """
SELECT g.*, p.population, l.county_geoid, n.n_links,
  CASE WHEN s.code IS NULL THEN 'out_of_scope' WHEN p.population IS NULL THEN 'no_population'
       WHEN p.population < 5000 THEN 'below_floor' END AS early,
  s.usps AS state_usps, CASE WHEN g.seg = 'BUILDING' THEN 'cdp' ELSE 'incorporated' END AS place_class
FROM gaz_p g LEFT JOIN states s ON substr(g.geo_id, 1, 2) = s.code LEFT JOIN pop_p p ON p.geo_id = g.geo_id
  LEFT JOIN primary_c l ON l.place_geoid = g.geo_id
  LEFT JOIN (SELECT place_geoid, count(*) AS n_links FROM shares GROUP BY 1) n ON n.place_geoid = g.geo_id""")
cte("rescue", f"""
SELECT g.geo_id, c.geo_id AS near_geoid FROM staged g JOIN cty c ON substr(c.geo_id, 1, 2) = substr(g.geo_id, 1, 2)
WHERE g.early IS NULL AND g.county_geoid IS NULL AND g.lat IS NOT NULL AND c.lat IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY g.geo_id ORDER BY {hav('g.lat', 'g.lon', 'c.lat', 'c.lon')}, c.geo_id) = 1""")
cte("disp", """
SELECT s.geo_id, s.name, s.state_usps, s.population, s.land_sqmi, s.lat, s.lon, s.place_class, s.n_links,
  coalesce(s.county_geoid, CASE WHEN s.early IS NULL THEN r.near_geoid END) AS county_geoid,
  coalesce(s.early, CASE WHEN s.county_geoid IS NOT NULL THEN 'kept' WHEN r.near_geoid IS NOT NULL THEN 'kept_by_centroid'
    ELSE 'no_county' END) AS disposition
FROM staged s LEFT JOIN rescue r ON r.geo_id = s.geo_id""")
cte("univ", """
SELECT * FROM cty UNION ALL
SELECT 'place', geo_id, name, state_usps, substr(geo_id, 1, 2), county_geoid, population, land_sqmi, lat, lon, place_class
FROM disp WHERE disposition LIKE 'kept%'""")

# ------------------------------------------------------------------------- A queries


@query("a1_norm_key", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN NULL WHEN c_custkey % 5 = 4 OR c_custkey > 9999999 THEN NULL
  ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS place_key,
  CASE WHEN c_custkey % 5 = 3 THEN 'not numeric' WHEN c_custkey % 5 = 4 OR c_custkey > 9999999 THEN 'longer than 7 digits' END AS fault
FROM customer""")
def a1(spark, sf):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("X"), k)).when(
        F.col("c_custkey") % 5 == 4, F.concat(k, F.lit("12345678"))
    ).otherwise(F.concat(F.lit(" "), k))
    return table(spark, sf, "customer").select(
        "c_custkey", keys.norm_key(raw, 7).alias("place_key"), keys.key_fault(raw, 7).alias("fault")
    )


@query("a2_in_scope", """
SELECT g.geo_id, s.code IS NOT NULL AS in_scope, substr(g.geo_id, 1, 2) AS state_fips, s.usps AS state_usps
FROM gaz_p g LEFT JOIN states s ON s.code = substr(g.geo_id, 1, 2)""")
def a2(spark, sf):
    g = gaz_places(spark, sf).select(keys.norm_key("geoid", 7).alias("geo_id"))
    return g.select("geo_id", keys.in_scope("geo_id").alias("in_scope"), keys.state_of("geo_id").alias("state_fips"),
                    keys.usps_of("geo_id").alias("state_usps"))


@query("a3_classify_place", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cdp' ELSE 'incorporated' END AS by_code,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'cdp' WHEN c_mktsegment = 'AUTOMOBILE' THEN
    CASE WHEN c_custkey % 2 = 0 THEN 'cdp' ELSE 'incorporated' END ELSE 'incorporated' END AS by_type FROM customer""")
def a3(spark, sf):
    seg = F.col("c_mktsegment")
    code = F.when(seg == "BUILDING", " 57").otherwise("25")
    kind = F.when(seg == "MACHINERY", "Census Designated Place").when(seg == "AUTOMOBILE", F.lit(None)).otherwise("City")
    alt = F.when((seg == "AUTOMOBILE") & (F.col("c_custkey") % 2 == 0), "57").otherwise("25")
    return table(spark, sf, "customer").select(
        "c_custkey", keys.classify_place(code).alias("by_code"), keys.classify_place(alt, kind).alias("by_type")
    )


@query("a4_crosswalk_normalise", "SELECT place_geoid, county_geoid, round(weight, 6) AS weight FROM shares")
def a4(spark, sf):
    return r6(links(spark, sf), "weight")


@query("a5_crosswalk_combine", "SELECT place_geoid, county_geoid, round(weight, 6) AS weight, basis FROM both_links")
def a5(spark, sf):
    return r6(combined_links(spark, sf), "weight")


@query("a5_crosswalk_stats", "SELECT basis, count(DISTINCT place_geoid) AS places FROM both_links GROUP BY 1")
def a5_stats(spark, sf):
    return uni.crosswalk_stats(combined_links(spark, sf))


@query("a6_primary_parent", "SELECT place_geoid, county_geoid FROM primary_c")
def a6(spark, sf):
    return uni.primary_parent(links(spark, sf))


cte("named", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS place_geoid, r_name AS usps,
  unnest(['NATION_' || c_nationkey, 'nation_' || (c_custkey % 40)]) AS name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
cte("name_hits", """
SELECT a.place_geoid, a.usps AS state_usps, a.name, i.county_geoid FROM named a LEFT JOIN (
  SELECT r_name, upper(n_name) AS n, '01' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_geoid
  FROM nation JOIN region ON r_regionkey = n_regionkey) i ON i.r_name = a.usps AND i.n = upper(a.name)""")


def _name_hits(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    index = uni.county_name_index(n.select((F.col("n_nationkey") + 1000).cast("string").alias("geoid"),
                                           F.col("r_name").alias("state_usps"), F.concat(F.lit(" "), "n_name").alias("name")))
    listed = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("~~~ nation_"),
                      (F.col("c_custkey") % 40).cast("string"), F.lit("~~~ "))
    places = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lpad(place_code(), 7, "0").alias("place_geoid"),
        F.col("r_name").alias("state_usps"), listed.alias("counties"))
    return uni.name_index_join(places, index)


@query("a7_name_index_join", "SELECT place_geoid, state_usps, name, county_geoid FROM name_hits WHERE county_geoid IS NOT NULL")
def a7(spark, sf):
    return _name_hits(spark, sf).where("county_geoid is not null")


@query("a7_unmatched_names",
       "SELECT state_usps, name, count(*) AS n FROM name_hits WHERE county_geoid IS NULL GROUP BY 1, 2")
def a7_unmatched(spark, sf):
    return _name_hits(spark, sf).where("county_geoid is null").groupBy("state_usps", "name").agg(F.count(F.lit(1)).alias("n"))


@query("a8_unmatched_keys", "SELECT geo_id AS place_geoid FROM gaz_p WHERE geo_id NOT IN (SELECT place_geoid FROM both_links)")
def a8(spark, sf):
    return uni.unmatched_keys(gaz_places(spark, sf).select(keys.norm_key("geoid", 7).alias("place_geoid")), combined_links(spark, sf))


@query("a9_haversine_miles", f"""
SELECT s.place_geoid, s.county_geoid, round({hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6) AS miles
FROM both_links s JOIN gaz_p p ON p.geo_id = s.place_geoid JOIN gaz_c c ON c.geo_id = s.county_geoid""")
def a9(spark, sf):
    p = gaz_places(spark, sf).select(keys.norm_key("geoid", 7).alias("place_geoid"),
                                     F.col("intptlat").try_cast("double").alias("lat"), F.col("intptlong").try_cast("double").alias("lon"))
    c = gaz_counties(spark, sf).select(keys.norm_key("geoid", 5).alias("county_geoid"),
                                       F.col("intptlat").try_cast("double").alias("c_lat"), F.col("intptlong").try_cast("double").alias("c_lon"))
    out = combined_links(spark, sf).select("place_geoid", "county_geoid").join(p, "place_geoid").join(c, "county_geoid")
    return r6(out.select("place_geoid", "county_geoid", haversine_miles("lat", "lon", "c_lat", "c_lon").alias("miles")), "miles")


@query("a10_nearest_within_state", f"""
SELECT p.geo_id AS place_geoid, c.geo_id AS county_geoid, round({hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 6) AS miles
FROM gaz_p p JOIN gaz_c c ON substr(c.geo_id, 1, 2) = substr(p.geo_id, 1, 2)
WHERE p.lat IS NOT NULL AND c.lat IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY p.geo_id ORDER BY {hav('p.lat', 'p.lon', 'c.lat', 'c.lon')}, c.geo_id) = 1""")
def a10(spark, sf):
    located = lambda g, w, n: g.select(keys.norm_key("geoid", w).alias(n), F.col("intptlat").try_cast("double").alias("lat"),
                                       F.col("intptlong").try_cast("double").alias("lon"))
    return r6(spatial.nearest_within_state(located(gaz_places(spark, sf), 7, "place_geoid"),
                                           located(gaz_counties(spark, sf), 5, "county_geoid")), "miles")


@query("a11_read_delimited_crosswalk", """
SELECT place_geoid, county_geoid, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE weight END AS weight
FROM raw_links WHERE c_mktsegment <> 'MACHINERY'""")
def a11(spark, sf):
    raw = raw_links(spark, sf).select(
        F.ltrim("place_geoid", F.lit("0")).alias("GEOID_PLACE"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("county_geoid")).otherwise("").alias(" Geoid_County "),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("weight").cast("string")).alias("POP_SHARE"),
    )
    return readers.crosswalk_rows(readers.tidy(raw))


@query("a12_population_centroids", "SELECT geo_id, lat, lon FROM gaz_c WHERE lat IS NOT NULL")
def a12(spark, sf):
    raw = coords(county_rows(spark, sf), "s_suppkey", 37, 53, 17).select(
        (F.col("s_nationkey") + 1).cast("string").alias("STATEFP"), (F.col("s_suppkey") % 1000).cast("string").alias("COUNTYFP"),
        F.col("intptlat").alias(" LATITUDE"), F.col("intptlong").alias("LONGITUDE "))
    return readers.population_centroids(readers.tidy(raw))


@query("a13_metro_crosswalk", """
SELECT geo_id, CAST(10000 + k % 7 AS VARCHAR) AS metro, 'Metro ' || (k % 7) || ', XX' AS title
FROM gaz_c JOIN states ON code = substr(geo_id, 1, 2)""")
def a13(spark, sf):
    s = county_rows(spark, sf)
    body = s.select(
        (F.col("s_suppkey") + 10).alias("line_no"),
        F.format_string('%d,"Metro %d, XX",%d,%d', F.col("s_suppkey") % 7 + 10000, F.col("s_suppkey") % 7,
                        F.col("s_nationkey") + 1, F.col("s_suppkey") % 1000).alias("value"))
    # Title rows and the header sit above the data, as in the published list.
    head = table(spark, sf, "region").where("r_regionkey = 0").select(F.posexplode(F.array(
        F.lit("List 1. Metropolitan areas"), F.lit(""), F.lit("CBSA Code,CBSA Title,FIPS State Code,FIPS County Code")
    )).alias("line_no", "value"))
    return readers.metro_crosswalk(head.select(F.col("line_no").cast("bigint").alias("line_no"), "value").unionByName(body))


@query("a14_read_gazetteer", "SELECT CAST(s_suppkey AS VARCHAR) AS geoid, s_name AS name, CAST(s_nationkey AS VARCHAR) AS usps FROM supplier")
def a14(spark, sf):
    pad = lambda c: F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" "))
    return readers.tidy(table(spark, sf, "supplier").select(
        pad("s_suppkey").alias(" GEOID"), pad("s_name").alias("NAME   "), pad("s_nationkey").alias("USPS ")))


@query("a15_build_counties", "SELECT * FROM cty")
def a15(spark, sf):
    return counties(spark, sf)


@query("a16_build_places", """
SELECT geo_id, name, state_usps, population, land_sqmi, lat, lon, place_class, n_links, county_geoid, disposition FROM disp""")
def a16(spark, sf):
    return dispositions(spark, sf)


@query("a16_place_links", """
SELECT s.place_geoid, s.county_geoid, round(s.weight, 6) AS weight FROM shares s JOIN disp d ON d.geo_id = s.place_geoid
WHERE d.disposition = 'kept' UNION ALL SELECT geo_id, county_geoid, 1.0 FROM disp WHERE disposition = 'kept_by_centroid'""")
def a16_links(spark, sf):
    return r6(uni.place_links(dispositions(spark, sf), links(spark, sf)), "weight")


@query("a17_build_universe", "SELECT * FROM univ")
def a17(spark, sf):
    return full_universe(spark, sf)


@query("a17_duplicate_keys", "SELECT geo_id, count(*) AS n FROM (SELECT geo_id FROM cty UNION ALL SELECT county_geoid FROM primary_c) GROUP BY 1 HAVING count(*) > 1")
def a17_dupes(spark, sf):
    ids = counties(spark, sf).select("geo_id").unionByName(uni.primary_parent(links(spark, sf)).select(F.col("county_geoid").alias("geo_id")))
    return uni.duplicate_keys(ids)


@query("a18_universe_report", """
SELECT 'places_total' AS counter, count(*) AS n FROM disp
UNION ALL SELECT 'places_kept', count(*) FROM disp WHERE disposition LIKE 'kept%'
UNION ALL SELECT 'places_below_floor', count(*) FROM disp WHERE disposition = 'below_floor'
UNION ALL SELECT 'places_no_population', count(*) FROM disp WHERE disposition = 'no_population'
UNION ALL SELECT 'places_unmatched_county', count(*) FROM disp WHERE disposition = 'no_county'
UNION ALL SELECT 'places_multi_county', count(*) FROM disp WHERE disposition = 'kept' AND n_links > 1
UNION ALL SELECT 'places_county_by_centroid', count(*) FROM disp WHERE disposition = 'kept_by_centroid'
UNION ALL SELECT 'incorporated', count(*) FROM disp WHERE disposition LIKE 'kept%' AND place_class = 'incorporated'
UNION ALL SELECT 'cdp', count(*) FROM disp WHERE disposition LIKE 'kept%' AND place_class = 'cdp'
UNION ALL SELECT 'places_out_of_scope', count(*) FROM disp WHERE disposition = 'out_of_scope'
UNION ALL SELECT 'counties', count(*) FROM cty
UNION ALL SELECT 'counties_out_of_scope', count(*) FROM gaz_c WHERE substr(geo_id, 1, 2) NOT IN (SELECT code FROM states)""")
def a18(spark, sf):
    return uni.universe_report(gaz_counties(spark, sf), counties(spark, sf), dispositions(spark, sf))


@query("a19_mark_baseline", """
SELECT geo_level, geo_id, geo_id IN ('0200001', '02001') AS is_baseline, geo_id NOT IN ('0200001', '02001') AS is_candidate FROM univ""")
def a19(spark, sf):
    return feat.mark_baseline(full_universe(spark, sf), ["0200001", "02001"]).select("geo_level", "geo_id", "is_baseline", "is_candidate")


@query("a20_population_union", "SELECT * FROM pop_p UNION ALL SELECT * FROM pop_c")
def a20(spark, sf):
    return uni.population_union(county_population(spark, sf), place_population(spark, sf))
