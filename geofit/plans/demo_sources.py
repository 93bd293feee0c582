"""Source normalisers over raw-shaped frames derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.operators import contracts as con
from geofit.operators import features as feat
from geofit.operators import spatial
from geofit.operators.lineage import scratch_path
from geofit.operators.registry import registry_frame
from geofit.plans import demo_base as base
from geofit.plans import demo_universe as du
from geofit.plans.catalog import cte, query, r6, table
from geofit.sources import normalise as no
from geofit.sources import readers, sinks

LEVELS = {
    "place": {"form_population": "people", "cost_income_to_home_ratio": "ratio", "form_mean_commute": "minutes",
              "comm_median_age": "years", "form_population_density": "people/sqmi", "spend": "usd"},
    "county": {
        "cost_property_tax_rate": "ratio", "econ_industry_diversity": "index", "econ_employment_growth_5y": "percent_change",
        **{i: "per10k" for i in no.NAICS_RATES.values()}, **{i: "count" for i in no.NAICS_TOTALS.values()},
        **{i: "degF" for i in no.NORMALS.values()}, "air_europe_hub_distance": "miles", "air_europe_destinations": "count",
        "air_europe_passengers": "passengers/year", **{i: "per100k" for i in no.INTENTS.values()},
        **{i: "index" for i in no.HAZARD_SCORES.values()}, "hazard_fatality_risk_per100k": "per100k",
        "safety_traffic_fatality_rate": "per100k", "env_pm25_annual": "ug/m3", **{i: "index" for i in no.MEASURES.values()},
        "sens_partisan_lean": "index", "sens_religious_adherence": "share", **{i: "usd" for i in no.CHILDCARE.values()},
        "cost_price_parity": "index", "edu_student_teacher_ratio": "ratio", "edu_district_choice_count": "count",
        "edu_spend_per_pupil": "usd", "edu_graduation_rate": "share", "cost_home_value_median": "usd",
        "env_natural_amenities": "index", "env_water_area_share": "share", "env_topographic_variation": "index"},
}


def source_registry(spark):
    return registry_frame(spark, [dict(indicator_id=i, geo_level=lv, unit=u, domain="d", curve="higher_better")
                                  for lv, units in LEVELS.items() for i, u in units.items()])


def emitted(spark, records, places=6):
    """Records through the ingest contract, values rounded for comparison."""
    long = con.emit_long(records, source_registry(spark), "driver tables", "2024")
    return r6(long.select("geo_level", "geo_id", "indicator_id", "value"), "value", places=places)


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def components(df):
    """Suppliers with county components as unpadded text."""
    return df.withColumns({"st": text(F.col("s_nationkey") + 1), "co": text(F.col("s_suppkey") % 1000), "key": du.county_code()})


def suppliers(spark, sf):
    """The suppliers that name counties."""
    return components(du.coords(du.county_rows(spark, sf), "s_suppkey", 37, 53, 17)).withColumn("k", F.col("s_suppkey"))


def lines(spark, sf):
    """Every line with its supplier's county."""
    s = components(table(spark, sf, "supplier")).withColumn("k", F.col("s_suppkey") % 1000)
    return table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))


cte("b_sup", """
SELECT s_suppkey AS k, s_nationkey AS nk, s_acctbal, s_name, lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id
FROM sup1 JOIN states ON code = lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0')""")
cte("b_line", """
SELECT l.*, s_suppkey % 1000 AS k, lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id
FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN states ON code = lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0')""")


def county(indicator, value, source="b_sup", tail="", places=6):
    return f"SELECT 'county' AS geo_level, geo_id, '{indicator}' AS indicator_id, round({value}, {places})::DOUBLE AS value FROM {source} {tail}"


# ------------------------------------------------------------------------- B1 B2 contract


def contract_records(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    m = k % 10
    return c.select(
        F.when(m == 1, "county").otherwise("place").alias("geo_level"),
        F.when(m == 2, text(k)).otherwise(F.lpad(text(k), 7, "0")).alias("geo_id"),
        F.when(m == 0, "nope").otherwise("spend").alias("indicator_id"),
        F.when(m == 3, "n/a").otherwise(text("c_acctbal")).alias("value"))


cte("b_rec", """
SELECT CASE c_custkey % 10 WHEN 1 THEN 'county' ELSE 'place' END AS geo_level, CASE c_custkey % 10 WHEN 2 THEN CAST(c_custkey AS VARCHAR)
  ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS geo_id, CASE c_custkey % 10 WHEN 0 THEN 'nope' ELSE 'spend' END AS indicator_id,
  CASE c_custkey % 10 WHEN 3 THEN NULL ELSE c_acctbal END AS value,
  CASE WHEN c_custkey % 10 = 0 THEN 'unregistered indicator' WHEN c_custkey % 10 = 1 THEN 'level disagrees with the registry'
    WHEN c_custkey % 10 = 2 AND length(CAST(c_custkey AS VARCHAR)) <> 7 THEN 'malformed key' END AS fault FROM customer""")


@query("b1_emit_long", "SELECT geo_level, geo_id, indicator_id, CASE WHEN value >= 0 THEN value END AS value, '2024' AS vintage, 'records' AS source_file FROM b_rec WHERE fault IS NULL")
def b1(spark, sf):
    return con.emit_long(contract_records(spark, sf), source_registry(spark), "records", "2024", strict=False)


@query("b1_emit_faults", "SELECT fault, indicator_id, geo_level, count(*) AS n FROM b_rec WHERE fault IS NOT NULL GROUP BY 1, 2, 3")
def b1_faults(spark, sf):
    return con.emit_faults(contract_records(spark, sf), source_registry(spark))


@query("b1_rejected_markers", "SELECT indicator_id, count(*) AS n FROM b_rec WHERE fault IS NULL AND value < 0 GROUP BY 1")
def b1_markers(spark, sf):
    return con.rejected_markers(contract_records(spark, sf), source_registry(spark))


@query("b2_write_interim", "SELECT geo_id, indicator_id, CASE WHEN value >= 0 THEN value END AS value FROM b_rec WHERE fault IS NULL")
def b2(spark, sf):
    path = con.write_interim(b1(spark, sf), scratch_path(spark, "interim"), "orders")
    return spark.read.parquet(path).select("geo_id", "indicator_id", "value")


# ------------------------------------------------------------------------- B3-B9 surveys and estimates


def matrices(spark, sf):
    """Each customer's survey answer as a two-row matrix file."""
    c = du.place_rows(spark, sf)
    pop = F.when(F.col("c_custkey") % 9 == 4, "").otherwise(text((F.col("c_acctbal") * 10).cast("bigint")))
    body = F.array(F.array(F.lit("NAME"), F.lit("B01003_001E"), F.lit("state"), F.lit("place")),
                   F.array(F.col("c_name"), pop, text(F.col("c_nationkey") + 1), text(F.col("c_custkey") % 100000)))
    return readers.json_matrix(c.select(F.to_json(body).alias("value")))


cte("b_mat", """
SELECT c_name, lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS geo_id,
  CASE WHEN c_custkey % 9 <> 4 THEN CAST(trunc(c_acctbal * 10) AS BIGINT) END AS pop FROM cus1""")


@query("b3_read_json_matrix", "SELECT 1 AS row_no, c_name AS name, CAST(pop AS VARCHAR) AS pop FROM b_mat")
def b3(spark, sf):
    return matrices(spark, sf).select("row_no", F.col("fields")["NAME"].alias("name"),
                                      F.nullif(F.col("fields")["B01003_001E"], F.lit("")).alias("pop"))


@query("b4_acs_ingest", """
SELECT 'place' AS geo_level, geo_id, 'form_population' AS indicator_id, CASE WHEN pop >= 0 THEN pop::DOUBLE END AS value FROM b_mat JOIN states ON code = substr(geo_id, 1, 2)""")
def b4(spark, sf):
    return emitted(spark, no.acs_ingest(matrices(spark, sf)))


@query("b4_acs_population", "SELECT geo_id, pop AS population FROM b_mat JOIN states ON code = substr(geo_id, 1, 2) WHERE pop >= 0")
def b4_population(spark, sf):
    return no.acs_population(matrices(spark, sf))


def bulk(spark, sf):
    k = F.col("c_custkey")
    prefix = F.when(k % 6 == 5, "0400000US").otherwise("1600000US")
    return du.place_rows(spark, sf).select(
        F.concat(prefix, F.lpad(du.place_code(), 7, "0")).alias("geo_id"),
        F.when(k % 8 == 7, "x").otherwise(text("c_acctbal")).alias("b01003_e001"))


@query("b5_acs_bulk_scan", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS geo_id, CAST(trunc(c_acctbal) AS BIGINT) AS value
FROM cus1 JOIN states ON code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') WHERE c_custkey % 6 <> 5 AND c_custkey % 8 <> 7 AND trunc(c_acctbal) >= 0""")
def b5(spark, sf):
    return no.acs_bulk_scan(bulk(spark, sf), "b01003_e001")


RATIOS = {"cost_income_to_home_ratio": ("rent", "income", "place"), "form_mean_commute": ("minutes", "riders", "place"),
          "comm_median_age": ("minutes", None, "place"), "cost_property_tax_rate": ("rent", "income", "county")}
cte("b_cells", """
SELECT CASE WHEN o_custkey % 4 = 1 THEN lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') ELSE lpad(CAST(o_custkey % 10000000 AS VARCHAR), 7, '0') END AS geo_id,
  max(o_totalprice) FILTER (o_orderstatus = 'F') AS rent, max(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') AS income,
  count(*)::DOUBLE AS minutes, count(*) FILTER (o_orderpriority = '5-LOW')::DOUBLE AS riders FROM orders GROUP BY 1""")


@query("b6_acs_ratio_indicators", """
SELECT 'place' AS geo_level, geo_id, 'cost_income_to_home_ratio' AS indicator_id, round(CASE WHEN income > 0 THEN rent / income END, 6) AS value FROM b_cells WHERE length(geo_id) = 7 AND rent IS NOT NULL
UNION ALL SELECT 'place', geo_id, 'form_mean_commute', round(CASE WHEN riders > 0 THEN minutes / riders END, 6) FROM b_cells WHERE length(geo_id) = 7
UNION ALL SELECT 'place', geo_id, 'comm_median_age', round(minutes, 6) FROM b_cells WHERE length(geo_id) = 7
UNION ALL SELECT 'county', geo_id, 'cost_property_tax_rate', round(CASE WHEN income > 0 THEN rent / income END, 6) FROM b_cells WHERE length(geo_id) = 5 AND rent IS NOT NULL""")
def b6(spark, sf):
    o = table(spark, sf, "orders")
    key = F.lpad(text(F.col("o_custkey") % 10000000), 7, "0")
    key = F.when(F.col("o_custkey") % 4 == 1, F.substring(key, 3, 5)).otherwise(key)
    one = o.groupBy(key.alias("geo_id")).agg(F.count(F.lit(1)).alias("minutes"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("riders"))
    cells = (
        o.where("o_orderstatus = 'F'").select(key.alias("geo_id"), F.lit("rent").alias("variable"), F.col("o_totalprice").alias("value"))
        .unionByName(o.where("o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'").select(key.alias("geo_id"), F.lit("income").alias("variable"), F.col("o_totalprice").alias("value")))
        .unionByName(one.select("geo_id", F.inline(F.array(
            F.struct(F.lit("minutes").alias("variable"), F.col("minutes").cast("double").alias("value")),
            F.struct(F.lit("riders").alias("variable"), F.col("riders").cast("double").alias("value")))))))
    return emitted(spark, no.acs_ratio_indicators(cells, RATIOS))


@query("b7_density", """
SELECT 'place' AS geo_level, geo_id, 'form_population_density' AS indicator_id, round(CASE WHEN land_sqmi > 0 THEN population / land_sqmi END, 6) AS value
FROM gaz_p LEFT JOIN pop_p USING (geo_id)""")
def b7(spark, sf):
    u = du.gaz_places(spark, sf).select(F.lit("place").alias("geo_level"), F.lpad("geoid", 7, "0").alias("geo_id"), F.col("aland_sqmi").cast("double").alias("land_sqmi"))
    return emitted(spark, no.density(u, du.place_population(spark, sf)))


def pep(spark, sf):
    c, s = du.place_rows(spark, sf), du.county_rows(spark, sf)
    bal = lambda b: text(F.abs(F.col(b)))
    places = c.select(F.when(F.col("c_mktsegment") == "BUILDING", "061").otherwise("162").alias("sumlev"), text(F.col("c_nationkey") + 1).alias("state"),
                      F.lit("0").alias("county"), text(F.col("c_custkey") % 100000).alias("place"), bal("c_acctbal").alias("popestimate2024"))
    counties = s.select(F.lit("050").alias("sumlev"), text(F.col("s_nationkey") + 1).alias("state"), text(F.col("s_suppkey") % 1000).alias("county"),
                        F.lit("0").alias("place"), F.when(F.col("s_suppkey") % 5 == 2, "X").otherwise(bal("s_acctbal")).alias("popestimate2024"))
    parts = du.raw_links(spark, sf).select(F.lit("157").alias("sumlev"), F.substring("place_geoid", 1, 2).alias("state"),
                                           F.substring("county_geoid", 3, 3).alias("county"), F.substring("place_geoid", 3, 5).alias("place"),
                                           text("weight").alias("popestimate2024"))
    return places.unionByName(counties).unionByName(parts)


@query("b8_pep_county_population", "SELECT geo_id, CAST(trunc(abs(s_acctbal)) AS BIGINT) AS population FROM b_sup WHERE k % 5 <> 2")
def b8c(spark, sf):
    return no.pep_population(pep(spark, sf), "county")


@query("b8_pep_place_population", """
SELECT lpad(CAST((c_nationkey + 1) * 100000 + c_custkey % 100000 AS VARCHAR), 7, '0') AS geo_id, CAST(trunc(abs(c_acctbal)) AS BIGINT) AS population
FROM cus1 JOIN states ON code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') WHERE c_mktsegment <> 'BUILDING'""")
def b8p(spark, sf):
    return no.pep_population(pep(spark, sf), "place")


@query("b9_pep_place_county_weights", "SELECT place_geoid, county_geoid, CAST(weight AS BIGINT) AS weight FROM raw_links JOIN states ON code = substr(place_geoid, 1, 2)")
def b9(spark, sf):
    return no.pep_place_county_weights(pep(spark, sf))


# ------------------------------------------------------------------------- B10-B13 business and jobs

CODES = ["722///", "71----", "445///", "713940", "------", "999999"]


@query("b10_cbp_rates", """
SELECT 'county' AS geo_level, geo_id, i AS indicator_id, round(CASE WHEN p.population > 0 THEN est / greatest(p.population, 10000) * 10000 END, 6) AS value
FROM (SELECT geo_id, l_linenumber % 6 AS c, sum(l_quantity) AS est FROM b_line GROUP BY 1, 2) JOIN (VALUES (0, 'amen_food_drink_per10k'), (1, 'amen_arts_rec_per10k'),
  (2, 'amen_grocery_per10k'), (3, 'amen_fitness_per10k'), (4, 'amen_establishments_per10k')) m(c, i) USING (c) LEFT JOIN pop_c p USING (geo_id)
UNION ALL SELECT 'county', geo_id, i, sum(l_quantity) FROM b_line JOIN (VALUES (0, 'amen_food_drink_total'), (1, 'amen_arts_rec_total')) m(c, i) ON c = l_linenumber % 6 GROUP BY 1, 2, 3""")
def b10(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    raw = lines(spark, sf).groupBy("st", "co", code.alias("naics")).agg(text(F.sum("l_quantity")).alias("est")).select(
        F.col("st").alias("fipstate"), F.col("co").alias("fipscty"), "naics", "est")
    return emitted(spark, no.cbp_rates(raw, du.county_population(spark, sf)))


def qcew(spark, sf, year=None):
    li = lines(spark, sf)
    li = li.where(F.year("l_shipdate") == year) if year else li
    sector = li.select(F.lpad("key", 5, "0").alias("area_fips"), F.lit("74").alias("agglvl_code"), F.when(F.col("l_linestatus") == "F", "5").otherwise("3").alias("own_code"),
                       F.concat("l_returnflag", text("l_linenumber")).alias("industry_code"), text("l_quantity").alias("annual_avg_emplvl"))
    total = li.groupBy("key").agg(F.sum("l_quantity").alias("q")).select(
        F.lpad("key", 5, "0").alias("area_fips"), F.lit("70").alias("agglvl_code"), F.lit("0").alias("own_code"), F.lit("10").alias("industry_code"), text("q").alias("annual_avg_emplvl"))
    return sector.unionByName(total)


@query("b11_qcew_read", "SELECT geo_id, l_returnflag || l_linenumber AS sector, sum(l_quantity) AS emp FROM b_line GROUP BY 1, 2")
def b11(spark, sf):
    return no.qcew_sectors(qcew(spark, sf))


@query("b12_inverse_hhi", county("econ_industry_diversity", "1 / sum(pow(e / t, 2))",
       "(SELECT geo_id, l_returnflag || l_linenumber AS sec, sum(l_quantity) AS e, sum(sum(l_quantity)) OVER (PARTITION BY geo_id) AS t FROM b_line GROUP BY 1, 2)", "GROUP BY geo_id"))
def b12(spark, sf):
    return emitted(spark, no.records(no.inverse_hhi(no.qcew_sectors(qcew(spark, sf))), "county", "econ_industry_diversity"))


@query("b13_employment_growth", county("econ_employment_growth_5y", "CASE WHEN b > 0 THEN (a - b) / b * 100 END", """(
  SELECT geo_id, sum(l_quantity) FILTER (year(l_shipdate) = 2000) AS a, sum(l_quantity) FILTER (year(l_shipdate) = 1995) AS b FROM b_line GROUP BY 1)""", "WHERE a IS NOT NULL"))
def b13(spark, sf):
    grown = no.employment_growth(no.qcew_totals(qcew(spark, sf, 2000)), no.qcew_totals(qcew(spark, sf, 1995)))
    return emitted(spark, no.records(grown, "county", "econ_employment_growth_5y"))


# ------------------------------------------------------------------------- B14-B18 climate and hubs

FIELDS = list(no.NORMALS)


def stations(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    cells = [F.when((k + i) % 4 == 1, "-9999").otherwise(text(F.round(F.col("s_acctbal") / 100 + i, 2))).alias(c) for i, c in enumerate(FIELDS)]
    return s.select(F.concat(F.lit("ST"), F.lpad(text(k), 12, "0")).alias("station"), text(F.round(35 + (k * 37 % 400) / 100, 2)).alias("latitude"),
                    F.when(k % 19 == 3, "-9999").otherwise(text(F.round(-90 + (k * 53 % 700) / 100, 2))).alias("longitude"), *cells)


cte("b_sta", "SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS station_id, round(35 + (s_suppkey * 37 % 400) / 100.0, 2)::DOUBLE AS lat, "
    "round(-90 + (s_suppkey * 53 % 700) / 100.0, 2)::DOUBLE AS lon, x.i AS indicator_id, x.v AS value FROM supplier, (SELECT unnest([" + ", ".join(
        f"{{'i': '{i}', 'n': {n}}}" for n, i in enumerate(no.NORMALS.values())) + "]) AS y) q, LATERAL (SELECT {'i': y.i, "
    "'v': CASE WHEN (s_suppkey + y.n) % 4 <> 1 THEN round(s_acctbal / 100 + y.n, 2) END} AS x) WHERE s_suppkey % 19 <> 3 AND x.v IS NOT NULL AND x.v > -999")


@query("b14_noaa_station_scan", "SELECT station_id, lat, lon, indicator_id, value FROM b_sta")
def b14(spark, sf):
    return no.station_readings(stations(spark, sf))


def homes(spark, sf):
    """One home for each five last digits of customers' numbers, at the mean of their places."""
    k = F.col("c_custkey")
    mean = lambda base, step, span: F.sum(base + k * step % span) / F.count(k) / 100
    return table(spark, sf, "customer").groupBy((k % 100000).alias("code")).agg(mean(3500, 29, 400).alias("lat"), mean(-9000, 41, 700).alias("lon")).select(
        F.lpad(text("code"), 5, "0").alias("geo_id"), "lat", "lon")


cte("b_home", """
SELECT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS geo_id, sum(3500 + c_custkey * 29 % 400) / count(*) / 100 AS lat, sum(-9000 + c_custkey * 41 % 700) / count(*) / 100 AS lon
FROM customer GROUP BY c_custkey % 100000""")
cte("b_near", f"""
SELECT h.geo_id, s.indicator_id, s.value, {du.hav('h.lat', 'h.lon', 's.lat', 's.lon')} AS miles, s.station_id FROM b_home h, b_sta s
WHERE {du.hav('h.lat', 'h.lon', 's.lat', 's.lon')} <= 75 QUALIFY row_number() OVER (PARTITION BY h.geo_id, s.indicator_id ORDER BY miles, s.station_id) <= 5""")


@query("b15_idw_knn", "SELECT 'county' AS geo_level, geo_id, indicator_id, round(sum(value / (miles + 1)) / sum(1 / (miles + 1)), 6) AS value FROM b_near GROUP BY 2, 3")
def b15(spark, sf):
    out = spatial.idw_knn(homes(spark, sf), no.station_readings(stations(spark, sf)))
    return emitted(spark, no.records(out, "county", F.col("indicator_id")))


def segments(spark, sf):
    wac = F.when(F.col("l_partkey") % 23 == 0, "x").otherwise(text(380 + F.col("l_partkey") % 140))
    return lines(spark, sf).select(F.concat(F.lit("H"), F.lpad(text("s_nationkey"), 2, "0")).alias("usg_apt"), F.concat(F.lit("F"), text(F.col("l_partkey") % (F.col("s_nationkey") + 3))).alias("fg_apt"),
                                   wac.alias("fg_wac"), F.when(F.col("l_returnflag") == "R", "Freight").otherwise("Passengers").alias("type"), text("l_quantity").alias("total"))


cte("b_hub", """
SELECT 'H' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS hub, count(DISTINCT l_partkey % (s_nationkey + 3)) AS destinations, sum(l_quantity) AS passengers
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 23 <> 0 AND 380 + l_partkey % 140 BETWEEN 400 AND 499 AND l_returnflag <> 'R'
GROUP BY 1 HAVING sum(l_quantity) >= 10000""")


@query("b16_hub_summary", "SELECT * FROM b_hub")
def b16(spark, sf):
    return no.hub_summary(segments(spark, sf))


def airports(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    cells = [text(k), F.col("n_name"), F.lit("city"), F.lit("country"), F.when(k % 6 == 5, "\\N").otherwise(F.concat(F.lit("H"), F.lpad(text(k), 2, "0"))),
             F.lit("ICAO"), text(F.round(33 + (k * 37 % 800) / 100, 2)), text(F.round(-92 + (k * 53 % 1100) / 100, 2)), F.lit("0")]
    return n.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)])


cte("b_air", """
SELECT 'H' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS hub, round(33 + (n_nationkey * 37 % 800) / 100.0, 2)::DOUBLE AS lat,
  round(-92 + (n_nationkey * 53 % 1100) / 100.0, 2)::DOUBLE AS lon FROM nation WHERE n_nationkey % 6 <> 5""")


@query("b17_read_airports", "SELECT * FROM b_air")
def b17(spark, sf):
    return no.read_airports(airports(spark, sf))


cte("b_best", f"""
SELECT h.geo_id, a.hub, destinations, passengers, {du.hav('h.lat', 'h.lon', 'a.lat', 'a.lon')} AS miles FROM b_home h, b_air a JOIN b_hub b ON b.hub = a.hub
QUALIFY row_number() OVER (PARTITION BY h.geo_id ORDER BY miles > 200, CASE WHEN miles <= 200 THEN -destinations END, miles, a.hub) = 1""")


@query("b18_best_hub_in_radius", """
SELECT 'county' AS geo_level, geo_id, 'air_europe_hub_distance' AS indicator_id, round(miles, 6) AS value FROM b_best
UNION ALL SELECT 'county', geo_id, 'air_europe_destinations', destinations FROM b_best
UNION ALL SELECT 'county', geo_id, 'air_europe_passengers', passengers FROM b_best""")
def b18(spark, sf):
    hubs = no.hub_summary(segments(spark, sf)).join(no.read_airports(airports(spark, sf)), "hub")
    best = spatial.hub_indicators(spatial.best_hub(homes(spark, sf), hubs))
    return emitted(spark, no.records(best, "county", F.col("indicator_id")))


# ------------------------------------------------------------------------- B19-B28


def injuries(spark, sf):
    k, s = F.col("k"), suppliers(spark, sf)
    intents = F.explode(F.array(F.lit("FA_Deaths"), F.lit("Drug_OD "), F.lit("All")))
    return s.select(F.col("key").alias("geoid"), intents.alias("intent"), F.when(k % 7 == 1, "*").otherwise("1-9").alias("count_sup"),
                    F.when(k % 7 == 2, "-999").when(k % 7 == 3, "").otherwise(text(F.abs("s_acctbal"))).alias("rate"))


@query("b19_cdc_injury", """
SELECT 'county' AS geo_level, geo_id, i AS indicator_id, CASE WHEN k % 7 NOT IN (1, 2, 3) THEN abs(s_acctbal) END AS value,
  CASE WHEN k % 7 IN (1, 3) THEN 'suppressed' WHEN k % 7 = 2 THEN 'negative' ELSE 'ok' END AS status
FROM b_sup, (VALUES ('safety_firearm_death_rate'), ('safety_overdose_death_rate')) t(i)""")
def b19(spark, sf):
    return no.cdc_injury(injuries(spark, sf))


def hazards(spark, sf):
    k, s = F.col("k"), suppliers(spark, sf)
    scores = [F.when((k + i) % 5 == 2, "").otherwise(text(F.abs("s_acctbal") + i)).alias(c) for i, c in enumerate(no.HAZARD_SCORES)]
    losses = [F.when((k + i) % 3 != 0, "").otherwise(text((k * (i + 1)) % 50)).alias(c) for i, c in enumerate(no.HAZARD_LOSSES[:6])]
    return s.select(F.col("key").alias("STCOFIPS"), F.when(k % 6 == 1, "").otherwise(text(F.abs("s_acctbal").cast("bigint") + 1)).alias("POPULATION"), *scores, *losses)


@query("b20_nri_hazards", "\nUNION ALL ".join(
    [county("hazard_fatality_risk_per100k", "CASE WHEN k % 6 <> 1 THEN (" + " + ".join(f"CASE WHEN (k + {i}) % 3 = 0 THEN (k * {i + 1}) % 50 ELSE 0 END" for i in range(6)) + ") / (trunc(abs(s_acctbal)) + 1) * 100000 END")]
    + [county(ind, f"CASE WHEN (k + {i}) % 5 <> 2 THEN abs(s_acctbal) + {i} END") for i, ind in enumerate(no.HAZARD_SCORES.values())]))
def b20(spark, sf):
    return emitted(spark, no.nri_hazards(hazards(spark, sf)))


@query("b21_fars_rate", """
SELECT 'county' AS geo_level, p.geo_id, 'safety_traffic_fatality_rate' AS indicator_id, round(CASE WHEN population >= 1000 THEN coalesce(d, 0) / population * 100000 END, 6) AS value
FROM pop_c p LEFT JOIN (SELECT geo_id, sum(l_linenumber) AS d FROM b_line WHERE k NOT IN (0, 997, 998, 999) AND l_returnflag = 'R' AND k % 4 <> 1 GROUP BY 1) USING (geo_id)""")
def b21(spark, sf):
    crashes = lines(spark, sf).where("l_returnflag = 'R' and k % 4 <> 1").select(F.col("st").alias("state"), F.col("co").alias("county"), text("l_linenumber").alias("fatals"))
    return emitted(spark, no.fars_rate(crashes, du.county_population(spark, sf)))


@query("b22_pm25_mean", county("env_pm25_annual", "avg(l_discount * 100)", "b_line", "WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY geo_id"))
def b22(spark, sf):
    raw = lines(spark, sf).select(F.col("st").alias("state code"), F.col("co").alias("county code"), F.when(F.col("l_returnflag") == "A", "PM2.5 - Local Conditions").otherwise("Ozone").alias("parameter name"),
                                  F.when(F.col("l_linestatus") == "F", "Daily Mean (24h)").otherwise("Observed").alias("metric used"), text(F.col("l_discount") * 100).alias("arithmetic mean"))
    return emitted(spark, no.pm25_mean(raw))


def rankings(spark, sf):
    k = F.col("k")
    cells = [F.when((k + i) % 6 == 1, "").otherwise(text(F.round(F.abs("s_acctbal") / 1000 - (0.5 if i == 1 else 0), 3))).alias(m) for i, m in enumerate(no.MEASURES)]
    return suppliers(spark, sf).select(F.col("key").alias("5-digit FIPS Code"), *cells)


@query("b23_chr_measures", "\nUNION ALL ".join(
    county(m, f"CASE WHEN (k + {i}) % 6 <> 1 THEN " + ("CASE WHEN round(abs(s_acctbal) / 1000 - 0.5, 3) > 0 THEN 1 / round(abs(s_acctbal) / 1000 - 0.5, 3) END" if m in no.INVERTED else "round(abs(s_acctbal) / 1000, 3)") + " END",
           tail="WHERE k % 1000 <> 0") for i, m in enumerate(no.MEASURES.values())))
def b23(spark, sf):
    return emitted(spark, no.chr_measures(rankings(spark, sf)))


@query("b24_available_measures", "\nUNION ALL ".join(f"SELECT '{m}' AS measure, count(*) FILTER ((s_suppkey + {i}) % 6 <> 1) AS n_values FROM sup1" for i, m in enumerate(no.MEASURES)))
def b24(spark, sf):
    raw = rankings(spark, sf)
    counts = raw.agg(*[F.count_if(F.col(f"`{m}`") != "").alias(m) for m in no.available_measures(raw)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("n_values")) for m in counts.columns])))


@query("b25_partisan_margin", county("sens_partisan_lean", "(a - b) / (a + b)", "(SELECT geo_id, count(*) FILTER (l_returnflag = 'A') / count(*) AS a, count(*) FILTER (l_returnflag = 'R') / count(*) AS b FROM b_line GROUP BY 1)", "WHERE substr(geo_id, 1, 2) <> '02'"))
def b25(spark, sf):
    share = lambda f: text(F.count_if(F.col("l_returnflag") == f) / F.count(F.lit(1)))
    raw = lines(spark, sf).groupBy("key").agg(share("A").alias("per_gop"), share("R").alias("per_dem")).withColumnRenamed("key", "county_fips")
    return emitted(spark, no.partisan_margin(raw))


@query("b26_adherence_share", """
SELECT 'county' AS geo_level, geo_id, 'sens_religious_adherence' AS indicator_id, round(abs(s_acctbal) / 7919, 6) AS value,
  CASE WHEN abs(s_acctbal) / 7919 > 1 THEN 'over 100%' ELSE 'ok' END AS status FROM b_sup""")
def b26(spark, sf):
    raw = suppliers(spark, sf).select(F.concat("key", F.lit(".0")).alias("fips"), F.lit("7919").alias("2020 population"), text(F.abs("s_acctbal")).alias("adherents"))
    return r6(no.adherence_share(raw), "value")


@query("b27_childcare_annual", "\nUNION ALL ".join(county(i, f"v * 52", f"(SELECT geo_id, s_acctbal + {n} AS v FROM b_sup)", "WHERE v > 0") for n, i in enumerate(no.CHILDCARE.values())))
def b27(spark, sf):
    year = F.explode(F.array(F.lit("2017"), F.lit("2018")))
    raw = suppliers(spark, sf).select(F.col("key").alias("county_fips_code"), year.alias("studyyear"), "s_acctbal").select(
        "county_fips_code", "studyyear", *[text(F.col("s_acctbal") + n).alias(c) for n, c in enumerate(no.CHILDCARE)])
    return emitted(spark, no.childcare_annual(raw))


@query("b28_rpp_to_county", county("cost_price_parity", "v", "b_sup LEFT JOIN (SELECT n_nationkey AS nk, 90 + n_nationkey / 4 AS v FROM nation WHERE n_nationkey % 7 <> 3) USING (nk)"))
def b28(spark, sf):
    n = F.col("n_nationkey")
    raw = table(spark, sf, "nation").where(n % 7 != 3).select(F.concat(F.lit('"'), text(n + 10000), F.lit('"')).alias("geofips"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("linecode"),
                                                             text(90 + n / 4).alias("2023"))
    members = suppliers(spark, sf).select(F.lpad("key", 5, "0").alias("geo_id"), text(F.col("s_nationkey") + 10000).alias("metro"))
    members = members.where(du.keys.in_scope("geo_id"))
    return emitted(spark, no.rpp_to_county(raw, members))


# ------------------------------------------------------------------------- B29 education


def directory(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(text(k).alias("leaid"), F.when(k % 31 == 4, "").otherwise(text((F.col("c_nationkey") + 1) * 1000 + k % 37)).alias("county_code"),
                                               F.when(k % 9 == 5, "-1").otherwise(text(F.abs("c_acctbal").cast("bigint"))).alias("enrollment"),
                                               F.when(k % 3 == 1, "-2").otherwise(text(k % 50)).alias("teachers_total_fte"))


def finance(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(text("o_custkey").alias("leaid"), F.when(k % 8 == 1, "-1").otherwise(text("o_totalprice")).alias("exp_current_elsec_total"),
                                             text(k % 300).alias("enrollment_fall_responsible"))


def grads(spark, sf):
    k = F.col("o_orderkey")
    axis = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "99").otherwise("3")
    return table(spark, sf, "orders").select(text("o_custkey").alias("leaid"), text(k % 101).alias("grad_rate_midpt"), text(k % 101).alias("grad_rate_low"), text(k % 101 + k % 26).alias("grad_rate_high"),
                                             text(k % 90 - 2).alias("cohort_num"), *[(axis if a == "race" else F.lit("99")).alias(a) for a in no.ALL_STUDENTS])


cte("b_dist", """
SELECT c_custkey AS leaid, lpad(CAST((c_nationkey + 1) * 1000 + c_custkey % 37 AS VARCHAR), 5, '0') AS geo_id,
  CASE WHEN c_custkey % 9 <> 5 THEN trunc(abs(c_acctbal)) END AS e, CASE WHEN c_custkey % 3 <> 1 THEN (c_custkey % 50)::DOUBLE END AS t
FROM customer JOIN states ON code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') WHERE c_custkey % 31 <> 4""")
cte("b_enr", """
SELECT geo_id, coalesce(sum(e), 0) AS enrolled, coalesce(sum(e) FILTER (t > 0 AND e > 0), 0) AS covered, coalesce(sum(t) FILTER (t > 0 AND e > 0), 0) AS teachers,
  count(*) FILTER (e > 0) AS districts FROM b_dist GROUP BY 1""")
cte("b_grad", """
SELECT geo_id, sum((o_orderkey % 101) / 100.0::DOUBLE * (o_orderkey % 90 - 2)) / sum(o_orderkey % 90 - 2) AS v, sum(o_orderkey % 90 - 2) AS cohort
FROM orders JOIN b_dist ON leaid = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 26 <= 20 AND o_orderkey % 90 - 2 > 0 GROUP BY 1""")


@query("b29_education_rollup", "\nUNION ALL ".join([
    county("edu_student_teacher_ratio", "covered / teachers", "b_enr", "WHERE teachers > 0 AND covered > 0 AND (enrolled = 0 OR covered >= 0.5 * enrolled)"),
    county("edu_district_choice_count", "districts", "b_enr", "WHERE districts > 0"),
    county("edu_spend_per_pupil", "sum(o_totalprice) / sum(o_orderkey % 300)", "orders JOIN b_dist ON leaid = o_custkey", "WHERE o_orderkey % 8 <> 1 AND o_orderkey % 300 > 0 GROUP BY geo_id"),
    county("edu_graduation_rate", "v", "b_grad JOIN b_enr USING (geo_id)", "WHERE enrolled = 0 OR cohort >= 0.5 * enrolled / 13")]))
def b29(spark, sf):
    return emitted(spark, no.education_rollup(directory(spark, sf), finance(spark, sf), grads(spark, sf)))


@query("b29_education_rejects", """
SELECT 'districts_without_county' AS reason, count(*) AS n FROM customer WHERE c_custkey % 31 = 4
UNION ALL SELECT 'ratios_dropped_unrepresentative', count(*) FROM b_enr WHERE teachers > 0 AND covered > 0 AND enrolled > 0 AND covered < 0.5 * enrolled
UNION ALL SELECT 'counties_without_a_district', count(*) FROM b_enr WHERE districts = 0
UNION ALL SELECT 'spend_markers_rejected', count(*) FROM orders WHERE o_orderkey % 8 = 1 AND o_custkey IN (SELECT leaid FROM b_dist)
UNION ALL SELECT 'grad_bins_too_wide', count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 90 - 2 > 0 AND o_orderkey % 26 > 20 AND o_custkey IN (SELECT leaid FROM b_dist)""")
def b29_rejects(spark, sf):
    return no.education_rejects(directory(spark, sf), finance(spark, sf), grads(spark, sf))


# ------------------------------------------------------------------------- B30-B33


def monthly(li, by, names, value):
    """A value per key and month of shipping, as a series of text cells; a month without one is blank."""
    month = F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-28")).alias("month")
    return li.groupBy(*by, month).agg(F.coalesce(text(value), F.lit("")).alias("value")).toDF(*names, "month", "value")


#: Prices are those of returned lines.
RETURNED = lambda: F.max(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
MONTHS_BACK = lambda n: f"(SELECT date_trunc('month', max(l_shipdate)) - INTERVAL {n} MONTH FROM lineitem)"
LATEST_SQL = f"""arg_max(l_extendedprice, struct_pack(m := date_trunc('month', l_shipdate), p := l_extendedprice))
  FILTER (l_returnflag = 'R' AND date_trunc('month', l_shipdate) > {MONTHS_BACK(12)})"""


@query("b30_latest_within_window", county("cost_home_value_median", LATEST_SQL, "b_line", "GROUP BY geo_id"))
def b30(spark, sf):
    series = monthly(lines(spark, sf), ["st", "co"], ["statecodefips", "municipalcodefips"], RETURNED())
    return emitted(spark, no.home_values(series, "cost_home_value_median"))


@query("b31_amenity_scale", "\nUNION ALL ".join([county("env_natural_amenities", "CASE WHEN k % 6 <> 2 THEN s_acctbal END"), county("env_water_area_share", "(k % 100) / 100.0"), county("env_topographic_variation", "k % 21")]))
def b31(spark, sf):
    raw = suppliers(spark, sf).select(F.col("key").alias(" FIPS Code "), F.when(F.col("k") % 6 == 2, "").otherwise(text("s_acctbal")).alias("Natural Amenities Scale"),
                                      text(F.col("k") % 100).alias("Water Percent"), text(F.col("k") % 21).alias("Topography"))
    return emitted(spark, no.amenity_scale(readers.tidy(raw)))


def flows(spark, sf, side):
    """Movers per supplier's county: one row per order line total, domestic rows marked 97."""
    flag = "A" if side == "in" else "R"
    return lines(spark, sf).where(F.col("l_returnflag") == flag).groupBy("st", "co", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("p")).select(
        F.col("st").alias("state"), F.col("co").alias("county"), F.when(F.col("l_linenumber") == 1, "97").otherwise("96").alias("marker"),
        F.when(F.col("co").cast("int") % (5 if side == "in" else 7) == 1, "-1").otherwise(text("p")).alias("people"))


cte("b_net", """
SELECT coalesce(i.g, o.g) AS geo_id, CAST(coalesce(i.p, 0) - coalesce(o.p, 0) AS BIGINT) AS net_migration FROM
  (SELECT lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS g, sum(l_quantity) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
   WHERE l_returnflag = 'A' AND l_linenumber = 1 AND s_suppkey % 1000 % 5 <> 1 GROUP BY 1) i FULL JOIN
  (SELECT lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS g, sum(l_quantity) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
   WHERE l_returnflag = 'R' AND l_linenumber = 1 AND s_suppkey % 1000 % 7 <> 1 GROUP BY 1) o ON i.g = o.g""")


@query("b32_migration_flows", "SELECT * FROM b_net")
def b32(spark, sf):
    return no.migration_flows(flows(spark, sf, "in"), flows(spark, sf, "out"))


def zips(spark, sf):
    li = table(spark, sf, "lineitem")
    return monthly(li.withColumn("z", text(F.col("l_partkey") % 99999)), ["z"], ["regionname"], RETURNED()).withColumn("state", F.lit("PA"))


cte("b_zip", f"SELECT lpad(CAST(l_partkey % 99999 AS VARCHAR), 5, '0') AS zcta, {LATEST_SQL} AS value FROM lineitem GROUP BY 1")


@query("b33_zip_values", "SELECT zcta, 'PA' AS state, round(value, 6) AS value FROM b_zip WHERE value IS NOT NULL")
def b33(spark, sf):
    return r6(no.zip_values(zips(spark, sf)), "value")


def overlap(spark, sf):
    """Parts a customer ordered are the ZIPs its land overlaps."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", (F.col("l_partkey") % 99999).alias("zip")).agg(F.sum("l_quantity").alias("q"))
    return j.select(F.lpad(text("zip"), 5, "0").alias("geoid_zcta5_20"), F.lpad(text("o_custkey"), 9, "0").alias("geoid_place_20"),
                    text("q").alias("arealand_part"), text(2 * F.col("q") + 100).alias("arealand_place_20"))


cte("b_over", """
SELECT lpad(CAST(l_partkey % 99999 AS VARCHAR), 5, '0') AS zcta, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS place, sum(l_quantity) AS part, 2 * sum(l_quantity) + 100 AS place_land
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey % 99999, o_custkey""")


@query("b33_zip_place_overlap", "SELECT * FROM b_over")
def b33_overlap(spark, sf):
    return no.zip_place_overlap(overlap(spark, sf))


# ------------------------------------------------------------------------- B34-B38


@query("b34_source_union", "SELECT geo_level, indicator_id, count(*) AS n, count(value) AS n_values FROM s_facts GROUP BY 1, 2")
def b34(spark, sf):
    return feat.source_union([base.place_facts(spark, sf), base.county_facts(spark, sf)]).groupBy("geo_level", "indicator_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


def document_files(spark, sf):
    content = F.col("text").cast("binary")
    return table(spark, sf, "documents").select(F.concat(F.lit("raw/"), text("doc_id"), F.lit(".txt")).alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("length"), "source")


@query("b35_file_manifest", "SELECT 'raw/' || doc_id || '.txt' AS path, sha256(text) AS sha256, strlen(text) AS bytes, false AS synthetic FROM documents")
def b35(spark, sf):
    return readers.manifest_rows(document_files(spark, sf))


@query("b36_verify_manifest", """
SELECT 'raw/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 13 = 5 THEN 'altered' WHEN doc_id % 17 = 3 THEN 'missing' WHEN doc_id % 19 = 2 THEN 'unrecorded' END AS problem
FROM documents WHERE doc_id % 13 = 5 OR doc_id % 17 = 3 OR doc_id % 19 = 2""")
def b36(spark, sf):
    d = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    actual = readers.manifest_rows(document_files(spark, sf)).withColumn("d", d)
    altered = F.when(F.col("d") % 13 == 5, F.reverse("sha256")).otherwise(F.col("sha256"))
    recorded = actual.where((F.col("d") % 19 != 2) | (F.col("d") % 13 == 5) | (F.col("d") % 17 == 3)).withColumn("sha256", altered).drop("d")
    return readers.verify_manifest(recorded, actual.where((F.col("d") % 17 != 3) | (F.col("d") % 13 == 5)).drop("d"))


@query("b37_synthetic_inputs", "SELECT 'raw/' || doc_id || '.txt' AS path, true AS synthetic FROM documents WHERE lang = 'de'")
def b37(spark, sf):
    m = table(spark, sf, "documents").select(F.concat(F.lit("raw/"), text("doc_id"), F.lit(".txt")).alias("path"), (F.col("lang") == "de").alias("synthetic"))
    return con.synthetic_inputs(m)


@query("b38_sinks", "SELECT geo_id, indicator_id, round(value, 6) AS value FROM s_feats WHERE geo_level = 'county' AND value IS NOT NULL")
def b38(spark, sf):
    f = base.county_features(spark, sf)
    tab = sinks.write_table(f, scratch_path(spark, "features"), ["indicator_id"])
    cols = ["geo_id", "indicator_id", "value"]
    out = sinks.write_core(spark.read.parquet(tab).select(*cols).groupBy("geo_id").agg(F.collect_list(F.struct("indicator_id", "value")).alias("facts")), scratch_path(spark, "core"))
    nested = spark.read.schema("geo_id string, facts array<struct<indicator_id:string,value:double>>").json(out)
    return r6(nested.select("geo_id", F.inline("facts")).where("value is not null"), "value")
