"""Map and visitor operators over the shared demo frames.

Factors regroup the demo indicators; each nation is a visitor with its own weights, home, cap
and choices; suppliers and nations are pins; parts are the ZIPs a customer's land overlaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.functions import curves
from geofit.functions.keys import clean_name
from geofit.operators import visitors as vis
from geofit.operators.lineage import cut, stored
from geofit.operators.registry import OPT_INS, OVERRIDES, local_frame
from geofit.plans import demo_base as base
from geofit.plans import demo_sources as src
from geofit.plans import demo_universe as du
from geofit.plans.catalog import cte, query, r6, table
from geofit.sources import normalise as no

FACTORS = [("cost", "balance"), ("cost", "big_order"), ("cost", "nation_balance"), ("market", "spend_total"), ("market", "spend_per_order"),
           ("market", "order_count"), ("market", "nation_spend"), ("care", "urgent_share"), ("care", "nation_discount"), ("climate", "suppliers"),
           ("climate", "diversity"), ("climate", "never_seen"), ("church", "open_share")]
FACTOR_IDS = ["cost", "market", "care", "climate", "church"]
PUBLIC = ["cost", "market", "care", "climate"]
PRESETS = [("few", 0, 0, 3), ("some", 1, 3, 5), ("many", 2, 5, 9)]
LAYERS = [("open", "open_share"), ("nopen", "nation_open")]


def factors(spark):
    return local_frame(spark, FACTORS, "factor string, indicator_id string")


def public(spark):
    return local_frame(spark, [(f,) for f in PUBLIC], "factor string")


def regrouped(spark):
    return vis.factor_regroup(base.registry(spark), factors(spark))


def factor_profile(spark):
    opt = local_frame(spark, [("factors", "open_share")], OPT_INS)
    over = local_frame(spark, [("factors", "open_share", False, "higher_better", None)], OVERRIDES)
    return vis.factor_profile(factors(spark), opt, over, base.profiles(spark))


def factor_scores(spark, sf, f=None):
    f = base.features(spark, sf) if f is None else f
    return vis.factor_scores(f, base.universe(spark, sf), regrouped(spark), factor_profile(spark))


def preset_scores(spark, f):
    presets = local_frame(spark, [(p, i) for p, i, _, _ in PRESETS], "preset string, position int")
    band = [(p, "suppliers", "ideal_band", vis_params(lo=lo, hi=hi, shoulder=2)) for p, _, lo, hi in PRESETS]
    point = [(p, "diversity", "ideal_point", vis_params(target=4.8 + i / 100, tol=0.05)) for p, i, _, _ in PRESETS]
    rows = local_frame(spark, band + point, f"preset string, indicator_id string, curve string, params {curves.PARAMS_TYPE}")
    return vis.preset_scores(f, regrouped(spark), "climate", presets, rows, ["never_seen"], base.profiles(spark))


def vis_params(**kw):
    from geofit.operators.registry import curve_params
    return curve_params(kw)


base.values("h_fac", "factor, indicator_id", FACTORS)
base.values("h_pre", "preset, position, lo, hi", [(p, i, float(lo), float(hi)) for p, i, lo, hi in PRESETS])
cte("h_all", "SELECT geo_level, geo_id, indicator_id, value, percentile FROM s_inh UNION ALL SELECT geo_level, geo_id, indicator_id, value, percentile FROM s_feats WHERE geo_level = 'county'")
cte("h_fs", f"""
SELECT geo_level, geo_id, factor, exp(avg(ln(greatest(d, 0.01)))) AS d FROM (SELECT f.geo_level, f.geo_id, factor, CASE WHEN indicator_id = 'open_share' THEN f.percentile ELSE
  {base.sql_desirability('r.curve', 'f.value', 'f.percentile', 'r.')} END AS d FROM h_all f JOIN h_fac USING (indicator_id) JOIN s_reg r USING (indicator_id)) WHERE d IS NOT NULL GROUP BY 1, 2, 3""")
cte("h_ps", """
SELECT geo_id, CAST(position AS INT) AS position, exp(avg(ln(greatest(d, 0.01)))) AS d FROM (
  SELECT geo_id, position, CASE WHEN value BETWEEN lo AND hi THEN 1 WHEN value < lo THEN greatest(0, 1 - (lo - value) / 2) ELSE greatest(0, 1 - (value - hi) / 2) END AS d
  FROM s_feats, h_pre WHERE indicator_id = 'suppliers' AND value IS NOT NULL
  UNION ALL SELECT geo_id, position, exp(-pow((value - 4.8 - position / 100) / 0.05, 2)) FROM s_feats, h_pre WHERE indicator_id = 'diversity' AND value IS NOT NULL) GROUP BY 1, 2""")
cte("h_town", "SELECT geo_id, county_geoid FROM s_univ WHERE geo_level = 'place'")


@query("h1_factor_regroup", "SELECT factor, count(DISTINCT indicator_id) AS indicators, count(value) AS n_values FROM h_fac LEFT JOIN s_feats USING (indicator_id) GROUP BY 1")
def h1(spark, sf):
    f = base.features(spark, sf).groupBy("indicator_id").agg(F.count("value").alias("n"))
    return regrouped(spark).join(f, "indicator_id", "left").groupBy(F.col("domain").alias("factor")).agg(
        F.count(F.lit(1)).alias("indicators"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_values"))


@query("h2_factor_scores", "SELECT geo_level, geo_id, factor, round(d, 6) AS d FROM h_fs")
def h2(spark, sf):
    return r6(factor_scores(spark, sf), "d")


@query("h3_preset_scores", "SELECT geo_id, position, round(d, 6) AS d FROM h_ps")
def h3(spark, sf):
    out = preset_scores(spark, base.county_features(spark, sf)).select("geo_id", F.posexplode("scores").alias("position", "d"))
    return r6(out.where("d is not null"), "d")


@query("h4_layer_values", "SELECT geo_level, geo_id, " + ", ".join(
    f"round(max({c}) FILTER (indicator_id = '{i}'), 6) AS {n}_{s}" for n, i in LAYERS for c, s in (("percentile", "pct"), ("value", "raw")))
    + " FROM s_feats WHERE indicator_id IN ('open_share', 'nation_open') GROUP BY 1, 2")
def h4(spark, sf):
    out = vis.layer_values(base.features(spark, sf), LAYERS)
    return r6(out, *out.columns[2:])


cte("h_area", """
SELECT place, sum(part * CAST(round(value * 100) AS BIGINT)) / sum(part) FILTER (value IS NOT NULL) / 100 AS value, least(1, sum(part) FILTER (value IS NOT NULL) / max(place_land)) AS share
FROM b_over LEFT JOIN b_zip USING (zcta) WHERE place IN (SELECT geo_id FROM s_univ) GROUP BY 1 HAVING sum(part) FILTER (value IS NOT NULL) / max(place_land) >= 0.05""")


def town_prices(spark, sf):
    """Prices are averaged in cents, whose land-weighted sums are exact."""
    cents = no.zip_values(src.zips(spark, sf)).withColumn("value", F.round(F.col("value") * 100))
    return vis.areal_interpolation(no.zip_place_overlap(src.overlap(spark, sf)), cents, base.universe(spark, sf), 0.05).withColumn("value", F.col("value") / 100)


@query("h5_areal_interpolation", "SELECT place, round(value, 4) AS value, round(share, 6) AS share FROM h_area")
def h5(spark, sf):
    return r6(r6(town_prices(spark, sf), "value", places=4), "share")


def shape_sql(rows, key, target):
    return f"""SELECT {key}, CASE WHEN std > 0 THEN least(greatest(({target}) / std, 0.5), 2.5) ELSE 1.0 END AS k, centre FROM (
  SELECT {key}, stddev_pop(ln(greatest(d, 0.01))) AS std, avg(ln(greatest(d, 0.01))) AS centre, count(*) AS n FROM {rows} GROUP BY 1) WHERE n > 1"""


def target_sql(rows, tail=""):
    return f"SELECT avg(std) FROM (SELECT stddev_pop(ln(greatest(d, 0.01))) AS std FROM {rows} {tail} GROUP BY factor HAVING count(*) > 1) WHERE std > 0"


PUBLIC_SQL = "WHERE factor <> 'church'"
cte("h_pub", f"SELECT * FROM h_fs {PUBLIC_SQL}")
cte("h_shape", shape_sql("h_pub", "factor", target_sql("h_pub")))
cte("h_alt", """
SELECT 'preset ' || position AS name, d FROM h_ps UNION ALL SELECT 'preset ' || position, d FROM h_town JOIN h_ps ON h_ps.geo_id = county_geoid
UNION ALL SELECT 'open higher', percentile FROM s_feats WHERE indicator_id = 'open_share' AND percentile IS NOT NULL
UNION ALL SELECT 'open lower', 1 - percentile FROM s_feats WHERE indicator_id = 'open_share' AND percentile IS NOT NULL
UNION ALL SELECT 'nopen even', exp(-pow((value - 0.33) / 0.05, 2)) FROM h_all WHERE indicator_id = 'nation_open' AND value IS NOT NULL""")


@query("h6_factor_shape", f"SELECT factor, round(k, 6) AS k, round(centre, 6) AS centre FROM ({shape_sql('h_fs', 'factor', target_sql('h_fs'))})")
def h6(spark, sf):
    return r6(vis.factor_shape(cut(factor_scores(spark, sf))), "k", "centre")


@query("h6_web_shapes", f"SELECT factor AS name, round(k, 6) AS k, round(centre, 6) AS centre FROM h_shape UNION ALL SELECT name, round(k, 6), round(centre, 6) FROM ({shape_sql('h_alt', 'name', target_sql('h_pub'))})")
def h6_web(spark, sf):
    f, u = base.features(spark, sf), base.universe(spark, sf)
    fs = cut(factor_scores(spark, sf, f))
    towns = u.where("geo_level = 'place'").select("geo_id", "county_geoid")
    ps = preset_scores(spark, f).select("geo_id", F.posexplode("scores").alias("i", "d")).select("geo_id", F.concat(F.lit("preset "), src.text("i")).alias("name"), "d")
    lv = vis.layer_values(f, LAYERS)
    county_raw = lv.where("geo_level = 'county'").select("geo_id", "nopen_raw")
    even = lambda df: df.select(F.lit("nopen even").alias("name"), vis.direction_value(F.lit("even"), F.lit(None), F.col("nopen_raw"), F.lit(0.33), F.lit(0.05)).alias("d"))
    place_pct = lv.where("geo_level = 'place'")
    alternatives = [
        ps.select("name", "d"), towns.join(ps.withColumnRenamed("geo_id", "county_geoid"), "county_geoid").select("name", "d"),
        place_pct.select(F.lit("open higher").alias("name"), F.col("open_pct").alias("d")), place_pct.select(F.lit("open lower").alias("name"), (1 - F.col("open_pct")).alias("d")),
        even(county_raw), even(towns.join(county_raw.withColumnRenamed("geo_id", "county_geoid"), "county_geoid")),
    ]
    alt = alternatives[0]
    for a in alternatives[1:]:
        alt = alt.unionByName(a)
    out = vis.factor_shape(fs, public(spark)).withColumnRenamed("factor", "name").unionByName(vis.alternative_shapes(alt, vis.shared_target(fs, public(spark))))
    return r6(out, "k", "centre")


def core(spark, sf):
    f = base.features(spark, sf)
    return vis.export_core(base.universe(spark, sf), factor_scores(spark, sf, f), f, FACTOR_IDS, factors(spark))


@query("h7_export_core", """
SELECT u.geo_id, format('{:.6e}', lat::DOUBLE)::DOUBLE AS lat, population, indicator_id, format('{:.3e}', value)::DOUBLE AS v
FROM s_univ u JOIN s_feats f USING (geo_id) JOIN h_fac USING (indicator_id) WHERE value IS NOT NULL""")
def h7(spark, sf):
    return core(spark, sf).select("geo_id", "lat", "population", F.inline("facts"))


@query("h7_export_vector", "SELECT geo_id, CAST(list_position(['" + "', '".join(FACTOR_IDS) + "'], factor) - 1 AS INT) AS i, format('{:.2e}', d)::DOUBLE AS v FROM h_fs")
def h7_vector(spark, sf):
    return core(spark, sf).select("geo_id", F.posexplode("f").alias("i", "v")).where("v is not null")


@query("h7_modal_vintage", """
SELECT o_orderpriority AS indicator_id, v AS vintage FROM (SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, v) = 1""")
def h7_vintage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("indicator_id"), src.text(F.year("o_orderdate")).alias("vintage"), F.col("o_totalprice").alias("value"))
    return vis.modal_vintage(o)


# ------------------------------------------------------------------------- H8-H13 one ranking per visitor

cte("h_cprice", "SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS county_geoid, max(abs(s_acctbal)) * 8 AS county_price FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY 1")
cte("h_price", """
SELECT t.geo_id, t.county_geoid, a.value AS town_price, c.county_price, coalesce(a.value, c.county_price) AS price,
  CASE WHEN a.value IS NOT NULL THEN 'town' WHEN c.county_price IS NOT NULL THEN 'county' END AS price_source
FROM h_town t LEFT JOIN h_area a ON a.place = t.geo_id LEFT JOIN h_cprice c USING (county_geoid)""")


def prices(spark, sf):
    towns = base.universe(spark, sf).where("geo_level = 'place'").select("geo_id", "county_geoid")
    own = town_prices(spark, sf).select(F.col("place").alias("geo_id"), F.col("value").alias("town_price"))
    fallback = table(spark, sf, "supplier").where("s_nationkey % 4 <> 1").groupBy(base.county_id("s_nationkey").alias("county_geoid")).agg((F.max(F.abs("s_acctbal")) * 8).alias("county_price"))
    return vis.price_fallback(towns.join(own, "geo_id", "left"), fallback)


@query("h8_price_fallback", "SELECT geo_id, round(price, 4) AS price, price_source, CASE WHEN price IS NULL THEN 'unk' WHEN price <= 60000 THEN 'ok' ELSE 'over' END AS budget FROM h_price")
def h8(spark, sf):
    out = prices(spark, sf).withColumn("budget", vis.budget_flag(F.col("price"), F.lit(60000.0)))
    return r6(out.select("geo_id", "price", "price_source", "budget"), "price", places=4)


SLOTS = PUBLIC + ["open", "nopen"]
cte("h_vis", """
SELECT 'v' || n_nationkey AS visitor_id, n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey % 3 END AS preset_index,
  lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0') AS home, lpad(CAST((n_nationkey * 7) % 25 AS VARCHAR), 5, '0') AS home_county, 50000.0 + n_nationkey * 1000 AS cap, n_nationkey % 2 = 0 AS budget_only FROM nation""")
cte("h_w", "SELECT visitor_id, slot, weight FROM (SELECT visitor_id, slot, CASE WHEN (i > 3 AND (k + i) % 2 = 0) OR (k * 7 + i * 3) % 11 = 10 THEN 0.0 ELSE ((k * 7 + i * 13) % 29 + 1)::DOUBLE END AS weight FROM h_vis, (VALUES "
    + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SLOTS)) + ") t(i, slot)) WHERE weight > 0")
cte("h_lay", "SELECT visitor_id, layer, CASE (k + i) % 3 WHEN 0 THEN 'higher' WHEN 1 THEN 'lower' ELSE 'even' END AS direction, 0.33 AS target, 0.1 AS tol FROM h_vis, (VALUES (4, 'open'), (5, 'nopen')) t(i, layer)")
cte("h_lf", """
SELECT u.geo_id, 'open' AS layer, percentile AS pct, value AS raw FROM s_univ u JOIN s_feats f ON f.geo_id = u.geo_id AND indicator_id = 'open_share'
UNION ALL SELECT u.geo_id, 'nopen', percentile, value FROM s_univ u JOIN s_feats f ON f.geo_id = u.county_geoid AND indicator_id = 'nation_open'""")
cte("h_vec", """
SELECT visitor_id, geo_id, slot, d AS v, weight FROM h_fs JOIN h_w ON slot = factor WHERE factor <> 'climate'
UNION ALL SELECT w.visitor_id, u.geo_id, 'climate', CASE WHEN s.preset_index IS NOT NULL AND EXISTS (SELECT 1 FROM h_ps p WHERE p.geo_id = u.county_geoid) THEN p.d ELSE f.d END, w.weight
FROM s_univ u JOIN h_w w ON w.slot = 'climate' JOIN h_vis s USING (visitor_id) LEFT JOIN h_ps p ON p.geo_id = u.county_geoid AND p.position = s.preset_index
  LEFT JOIN h_fs f ON f.geo_id = u.geo_id AND f.factor = 'climate'
UNION ALL SELECT l.visitor_id, geo_id, layer, CASE direction WHEN 'higher' THEN pct WHEN 'lower' THEN 1 - pct ELSE exp(-pow((raw - target) / tol, 2)) END, w.weight
FROM h_lf JOIN h_lay l USING (layer) JOIN h_w w ON w.visitor_id = l.visitor_id AND w.slot = layer""")
# What a layer shows in each direction, and each preset, to every county and place.
cte("h_valt", """
SELECT 'preset ' || position AS name, d FROM h_ps UNION ALL SELECT 'preset ' || position, d FROM h_town JOIN h_ps ON h_ps.geo_id = county_geoid
UNION ALL SELECT layer || ' higher', pct FROM h_lf WHERE pct IS NOT NULL UNION ALL SELECT layer || ' lower', 1 - pct FROM h_lf WHERE pct IS NOT NULL
UNION ALL SELECT layer || ' even', exp(-pow((raw - 0.33) / 0.1, 2)) FROM h_lf WHERE raw IS NOT NULL""")
cte("h_vshape", f"SELECT factor AS name, k, centre FROM h_shape UNION ALL SELECT name, k, centre FROM ({shape_sql('h_valt', 'name', target_sql('h_pub'))})")
cte("h_vslot", """
SELECT w.visitor_id, w.slot, CASE WHEN a.name IS NOT NULL THEN a.k ELSE b.k END AS k, CASE WHEN a.name IS NOT NULL THEN a.centre ELSE b.centre END AS centre
FROM h_w w JOIN h_vis v USING (visitor_id) LEFT JOIN h_lay l ON l.visitor_id = w.visitor_id AND l.layer = w.slot
  LEFT JOIN h_vshape a ON a.name = CASE WHEN w.slot = 'climate' AND v.preset_index IS NOT NULL THEN 'preset ' || v.preset_index WHEN l.direction IS NOT NULL THEN w.slot || ' ' || l.direction ELSE w.slot END
  LEFT JOIN h_vshape b ON b.name = w.slot""")
cte("h_vs", """
SELECT visitor_id, v.geo_id, exp(sum(weight * CASE WHEN k IS NULL OR k = 1 THEN ln(greatest(v, 0.01)) ELSE centre + k * (ln(greatest(v, 0.01)) - centre) END) / sum(weight)) AS score,
  sum(weight) / any_value(total) AS cov FROM h_vec v LEFT JOIN h_vslot USING (visitor_id, slot) JOIN (SELECT visitor_id, sum(weight) AS total FROM h_w GROUP BY 1) USING (visitor_id) WHERE v IS NOT NULL GROUP BY 1, 2""")
cte("h_ok", "SELECT visitor_id, geo_id, score FROM h_vs WHERE cov >= 0.8")


def visitors(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("v"), src.text(k)).alias("visitor_id"), k.alias("k"), F.when(k % 4 != 3, k % 3).alias("preset_index"), F.lpad(src.text(k * 3), 9, "0").alias("home"),
        F.lpad(src.text((k * 7) % 25), 5, "0").alias("home_county"), (50000.0 + k * 1000).alias("cap"), (k % 2 == 0).alias("budget_only"))


def visitor_weights(spark, sf):
    slot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("slot")) for i, s in enumerate(SLOTS)]))
    k, i = F.col("k"), F.col("s.i")
    off = ((i > 3) & ((k + i) % 2 == 0)) | ((k * 7 + i * 3) % 11 == 10)
    return visitors(spark, sf).select("visitor_id", "k", slot.alias("s")).select("visitor_id", "s.slot", F.when(off, 0.0).otherwise(((k * 7 + i * 13) % 29 + 1).cast("double")).alias("weight"))


def visitor_layers(spark, sf):
    lay = F.explode(F.array(F.struct(F.lit(4).alias("i"), F.lit("open").alias("layer")), F.struct(F.lit(5).alias("i"), F.lit("nopen").alias("layer"))))
    m = (F.col("k") + F.col("l.i")) % 3
    return visitors(spark, sf).select("visitor_id", "k", lay.alias("l")).select("visitor_id", "l.layer", F.when(m == 0, "higher").when(m == 1, "lower").otherwise("even").alias("direction"), F.lit(0.33).alias("target"), F.lit(0.1).alias("tol"))


def visitor_pairs(spark, sf):
    """Every visitor at every county and place, with the values that each weighs there."""
    f, u = base.features(spark, sf), base.universe(spark, sf)
    fs = cut(factor_scores(spark, sf, f))
    at = u.select("geo_id", "county_geoid")
    own = f.where("indicator_id = 'open_share'").select("geo_id", F.lit("open").alias("layer"), F.col("percentile").alias("pct"), F.col("value").alias("raw"))
    county = f.where("indicator_id = 'nation_open'").select(F.col("geo_id").alias("county_geoid"), F.lit("nopen").alias("layer"), F.col("percentile").alias("pct"), F.col("value").alias("raw"))
    facts = own.unionByName(at.join(county, "county_geoid").select("geo_id", "layer", "pct", "raw"))
    presets = cut(preset_scores(spark, f).withColumnRenamed("geo_id", "county_geoid"))

    # Shapes: of the public factors, and of each preset and layer direction as every county and place shows it.
    by_preset = presets.select("county_geoid", F.posexplode("scores").alias("i", "d")).select("county_geoid", F.concat(F.lit("preset "), src.text("i")).alias("name"), "d")
    towns = u.where("geo_level = 'place'").select("county_geoid")
    ways = [F.struct(F.concat_ws(" ", "layer", F.lit(way)).alias("name"), vis.direction_value(F.lit(way), F.col("pct"), F.col("raw"), F.lit(0.33), F.lit(0.1)).alias("d")) for way in ("higher", "lower", "even")]
    alternatives = by_preset.select("name", "d").unionByName(towns.join(by_preset, "county_geoid").select("name", "d")).unionByName(facts.select(F.inline(F.array(*ways))))
    shapes = vis.factor_shape(fs, public(spark)).withColumnRenamed("factor", "name").unionByName(vis.alternative_shapes(alternatives, vis.shared_target(fs, public(spark))))

    places = vis.place_vectors(at, fs.select("geo_id", "factor", "d"), PUBLIC, presets, facts, ["open", "nopen"])
    slots = vis.visitor_slots(visitors(spark, sf), visitor_weights(spark, sf), visitor_layers(spark, sf), shapes, SLOTS, "climate")
    return vis.visitor_pairs(places, slots, len(PUBLIC), 2, PUBLIC.index("climate"))


def visitor_scores(spark, sf):
    return vis.visitor_scores(visitor_pairs(spark, sf), len(SLOTS))


@query("h9_visitor_vector", "SELECT visitor_id, geo_id, slot, round(v, 6) AS v, weight FROM h_vec WHERE v IS NOT NULL")
def h9(spark, sf):
    return r6(vis.visitor_vector(visitor_pairs(spark, sf), SLOTS), "v")


@query("h9_visitor_scores", "SELECT visitor_id, geo_id, round(score, 6) AS score, cov >= 0.8 AS ok FROM h_vs")
def h9_scores(spark, sf):
    return r6(visitor_scores(spark, sf).select("visitor_id", "geo_id", "score", "ok"), "score")


def town_scores(spark, sf):
    return stored(visitor_scores(spark, sf).where(F.length("geo_id") == 9))


cte("h_tok", "SELECT o.*, geo_id = home AS is_home FROM h_ok o JOIN h_vis USING (visitor_id) WHERE length(geo_id) = 9")
cte("h_tn", "SELECT visitor_id, count(*) FILTER (NOT is_home) AS n FROM h_tok GROUP BY 1")
cte("h_trank", """
SELECT visitor_id, geo_id, row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, geo_id) AS rank FROM h_tok WHERE NOT is_home
UNION ALL SELECT h.visitor_id, h.geo_id, 1 + (SELECT count(*) FROM h_tok o WHERE o.visitor_id = h.visitor_id AND NOT o.is_home AND o.score > h.score) FROM h_tok h WHERE is_home""")


@query("h10_rank_towns", "SELECT visitor_id, geo_id, rank, round(1 - (rank - 1) / greatest(1, n - 1), 6) AS pct FROM h_trank JOIN h_tn USING (visitor_id)")
def h10(spark, sf):
    return r6(vis.rank_towns(town_scores(spark, sf), visitors(spark, sf).select("visitor_id", "home")).select("visitor_id", "geo_id", "rank", "pct"), "pct")


@query("h11_challengers", """
SELECT c.visitor_id, county_geoid, town, CAST(row_number() OVER (PARTITION BY c.visitor_id ORDER BY c.score DESC, county_geoid) AS INT) AS n
FROM (SELECT visitor_id, geo_id AS county_geoid, score FROM h_ok WHERE length(geo_id) = 5) c JOIN h_vis v USING (visitor_id) JOIN (
  SELECT o.visitor_id, p.county_geoid, arg_min(o.geo_id, struct_pack(s := -o.score, g := o.geo_id)) AS town FROM h_ok o JOIN h_price p USING (geo_id) JOIN h_vis v USING (visitor_id)
  WHERE NOT (budget_only AND coalesce(price > cap, false)) GROUP BY 1, 2) USING (visitor_id, county_geoid) WHERE county_geoid <> home_county QUALIFY n <= 8""")
def h11(spark, sf):
    s = cut(visitor_scores(spark, sf))
    out = vis.challengers(s.where(F.length("geo_id") == 5), s.where(F.length("geo_id") == 9), prices(spark, sf).select("geo_id", "county_geoid", "price"),
                          visitors(spark, sf).select("visitor_id", "home_county", "cap", "budget_only"))
    return out.select("visitor_id", "county_geoid", "town", "n")


cte("h_near", f"""
SELECT 's' || s_suppkey AS pin, u.geo_id, {du.hav('s.la', 's.lo', 'u.lat', 'u.lon')} AS miles FROM (SELECT *, 25 + (s_suppkey * 37 % 2400) / 100.0::DOUBLE AS la, -124 + (s_suppkey * 53 % 5700) / 100.0::DOUBLE AS lo FROM supplier) s
  JOIN s_univ u ON geo_level = 'place' WHERE {du.hav('s.la', 's.lo', 'u.lat', 'u.lon')} <= 25 + s_suppkey % 100""")


def near(spark, sf, grouped=False):
    k = F.col("s_suppkey")
    pins = table(spark, sf, "supplier").select(F.concat(F.lit("s"), src.text(k)).alias("pin"), (25 + (k * 37 % 2400) / 100).alias("lat"), (-124 + (k * 53 % 5700) / 100).alias("lon"), (25 + k % 100).cast("double").alias("radius"))
    return vis.towns_within(pins, base.universe(spark, sf).where("geo_level = 'place'"), 125.0, grouped)


@query("h12_within_radius", "SELECT pin, geo_id, round(miles, 6) AS miles FROM h_near")
def h12(spark, sf):
    return r6(near(spark, sf), "miles")


@query("h13_pin_summary", """
SELECT visitor_id, pin, count(*) AS towns, arg_min(o.geo_id, struct_pack(s := -o.score, g := o.geo_id)) AS best,
  arg_min(o.geo_id, struct_pack(s := -o.score, g := o.geo_id)) FILTER (price <= cap) AS best_ok, count(*) FILTER (price <= cap) AS under
FROM h_near n JOIN h_ok o USING (geo_id) JOIN h_vis v USING (visitor_id) LEFT JOIN h_price p ON p.geo_id = n.geo_id GROUP BY 1, 2""")
def h13(spark, sf):
    return vis.pin_summary(near(spark, sf, grouped=True), town_scores(spark, sf), prices(spark, sf).select("geo_id", "price"), visitors(spark, sf).select("visitor_id", "cap"))


@query("h14_place_search", """
SELECT query_id, n, geo_id, label FROM (SELECT q.query_id, u.geo_id, u.name || ', ' || u.state_usps AS label,
  CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY starts_with(lower(u.name || ' ' || u.state_usps), q.t) DESC, coalesce(u.population, 0) DESC, u.geo_id) AS INT) AS n
  FROM (SELECT s_suppkey AS query_id, lower(CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN '0' || s_suppkey || ' r' WHEN 2 THEN 'r' || s_suppkey % 10 ELSE 'x' END) AS t FROM supplier) q
  JOIN s_univ u ON contains(lower(u.name || ' ' || u.state_usps), q.t) WHERE length(q.t) >= 2) WHERE n <= 8""")
def h14(spark, sf):
    k, n = F.col("s_suppkey"), src.text("s_suppkey")
    q = F.when(k % 4 == 0, F.concat(F.lit(" NATION_"), src.text("s_nationkey"))).when(k % 4 == 1, F.concat(F.lit("0"), n, F.lit(" R"))).when(k % 4 == 2, F.concat(F.lit("R"), src.text(k % 10), F.lit(" "))).otherwise("x")
    return vis.place_search(table(spark, sf, "supplier").select(k.alias("query_id"), q.alias("q")), base.universe(spark, sf))


# ------------------------------------------------------------------------- H15-H19 answers

OPTIONS = [("cost", "view", "scale", "cost", 1.6), ("cost", "click", "scale", "cost", 0.6), ("nature", "view", "scale", "market", 1.8), ("nature", "view", "scale", "care", 0.55),
           ("nature", "error", "scale", "care", 1.35), ("work", "signup", "share", "jobs", 7), ("work", "view", "share", "jobs", 14), ("kids", "purchase", "share", "jobs", 4), ("kids", "click", "share", "climate", 12)]
QUESTIONS = ["cost", "nature", "work", "kids"]
DEFAULTS = [("cost", 40.0), ("market", 25.0), ("care", 20.0), ("climate", 15.0), ("jobs", 0.0)]
base.values("h_opt", "question, option, kind, slot, amount", [(q, o, k, s, float(a)) for q, o, k, s, a in OPTIONS])
base.values("h_def", "slot, default_weight", DEFAULTS)
cte("h_ans", "SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'cost' WHEN 1 THEN 'nature' WHEN 2 THEN 'work' ELSE 'kids' END AS question, arg_max(event_type, event_id) AS option, CAST(event_id % 4 AS INT) AS step FROM events GROUP BY 1, 2, 4")
cte("h_cho", """
SELECT user_id, slot, coalesce(product(amount) FILTER (kind = 'scale'), 1) AS scale, arg_max(amount, step) FILTER (kind = 'share') AS share FROM h_ans JOIN h_opt USING (question, option) GROUP BY 1, 2""")
cte("h_raww", """
SELECT user_id, slot, coalesce(share, CASE WHEN sum(free) OVER w > 0 THEN free * (100 - sum(coalesce(share, 0)) OVER w) / sum(free) OVER w ELSE 0 END) AS weight FROM (
  SELECT p.user_id, d.slot, share, CASE WHEN share IS NULL THEN default_weight * coalesce(scale, 1) ELSE 0 END AS free FROM (SELECT DISTINCT user_id FROM events) p, h_def d LEFT JOIN h_cho c ON c.user_id = p.user_id AND c.slot = d.slot) WINDOW w AS (PARTITION BY user_id)""")


def lr_sql(rows, by):
    return f"""SELECT {by}, slot, CAST(f + CASE WHEN w > 0 AND rn <= short THEN 1 ELSE 0 END AS BIGINT) AS points FROM (SELECT *, 100 - sum(f) OVER (PARTITION BY {by}) AS short,
  row_number() OVER (PARTITION BY {by} ORDER BY w > 0 DESC, round(w - f, 9) DESC, slot) AS rn FROM (SELECT *, floor(w) AS f FROM (
  SELECT {by}, slot, CASE WHEN sum(weight) OVER (PARTITION BY {by}) > 0 THEN weight * 100 / sum(weight) OVER (PARTITION BY {by}) ELSE 0 END AS w FROM {rows})))"""


cte("h_pts", lr_sql("h_raww", "user_id"))


def answers(spark, sf):
    step = (F.col("event_id") % 4).cast("int")
    question = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), step + 1)
    return table(spark, sf, "events").groupBy("user_id", question.alias("question"), step.alias("step")).agg(F.max_by("event_type", "event_id").alias("option"))


def option_args(spark, sf):
    people = table(spark, sf, "events").select("user_id").distinct()
    return people, local_frame(spark, DEFAULTS, "slot string, default_weight double"), local_frame(
        spark, [(q, o, k, s, float(a)) for q, o, k, s, a in OPTIONS], "question string, option string, kind string, slot string, amount double"), answers(spark, sf)


@query("h15_weights_from_options", "SELECT user_id, slot, round(weight, 6) AS weight FROM h_raww")
def h15(spark, sf):
    return r6(vis.raw_option_weights(*option_args(spark, sf), "user_id"), "weight")


@query("h16_largest_remainder", "SELECT * FROM h_pts")
def h16(spark, sf):
    return vis.weights_from_options(*option_args(spark, sf), "user_id")


BANDS = [("snowy", 0, 0, 2000), ("cold", 1, 2000, 4000), ("mild", 2, 4000, 6500), ("warm", 3, 6500, 9000), ("hot", 4, 9000, 12000)]
base.values("h_band", "preset, position, lo, hi", [(p, i, float(a), float(b)) for p, i, a, b in BANDS])
cte("h_np", "SELECT c_custkey, CAST(position AS INT) AS position FROM customer, h_band QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs((lo + hi) / 2 - abs(c_acctbal)), position) = 1")


def winters(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("winter"))


def bands(spark):
    return local_frame(spark, [(p, i, float(a), float(b)) for p, i, a, b in BANDS], "preset string, position int, lo double, hi double")


@query("h17_nearest_preset", "SELECT c_custkey, position FROM h_np")
def h17(spark, sf):
    return vis.nearest_preset(winters(spark, sf), bands(spark)).select("c_custkey", "position")


@query("h17_climate_choices", """
SELECT c_custkey, CAST(least(4, greatest(0, position + s)) AS INT) AS preset_position, CAST(arg_min(s, struct_pack(a := abs(s), s := s)) AS INT) AS step FROM h_np, (VALUES (-2), (-1), (0), (1), (2)) t(s) GROUP BY 1, 2""")
def h17_choices(spark, sf):
    return vis.climate_choices(winters(spark, sf), bands(spark), "c_custkey")


cte("h_mean", "SELECT user_id // 2 AS household, slot, avg(points) AS weight FROM h_pts GROUP BY 1, 2")


@query("h18_blend_couple", f"""
SELECT household, slot, points, preset_position FROM ({lr_sql('h_mean', 'household')}) LEFT JOIN (
  SELECT user_id // 2 AS household, CAST(floor(avg(user_id % 5) + 0.5) AS INT) AS preset_position FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 1 GROUP BY 1) USING (household)""")
def h18(spark, sf):
    house = F.expr("user_id div 2").alias("household")
    each = vis.weights_from_options(*option_args(spark, sf), "user_id").select(house, "user_id", "slot", "points")
    u = F.col("user_id")
    climates = table(spark, sf, "events").select("user_id").distinct().select(house, "user_id", F.when(u % 3 != 1, u % 5).alias("preset_position"))
    points, climate = vis.blend_couple(each, climates)
    return points.join(climate, "household", "left")


@query("h19_settings_upgrade", "SELECT c_custkey, slot, CASE WHEN slot = 'cost' AND c_custkey % 3 <> 1 THEN c_acctbal WHEN slot = 'care' AND c_custkey % 3 = 2 THEN 5.0 ELSE default_weight END AS weight FROM customer, h_def")
def h19(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    saved = F.when(k % 3 == 0, F.create_map(F.lit("cost"), bal, F.lit("foreign"), F.lit(9.0))).when(k % 3 == 2, F.create_map(F.lit("cost"), bal, F.lit("care"), F.lit(5.0)))
    out = vis.settings_upgrade(table(spark, sf, "customer").select("c_custkey", saved.alias("weights")), dict(DEFAULTS))
    return out.select("c_custkey", F.explode("weights").alias("slot", "weight"))


@query("h19_legacy_answers", """
SELECT user_id AS visitor_id, CASE WHEN t IN ('view', 'click') THEN CASE WHEN now THEN 'family' ELSE 'couple' END WHEN now THEN 'kids' ELSE 'solo' END AS who,
  CASE WHEN NOT now THEN CASE WHEN user_id % 3 = 1 THEN 'yes' ELSE 'no' END END AS kids_future, CASE user_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'partly' WHEN 2 THEN 'local' END AS work, t AS flights
FROM (SELECT user_id, arg_max(event_type, event_id) AS t, user_id % 3 = 0 AS now FROM events GROUP BY 1)""")
def h19_legacy(spark, sf):
    u = F.col("user_id")
    saved = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("flights")).select(
        u.alias("visitor_id"), F.when(F.col("flights").isin("view", "click"), "couple").otherwise("single").alias("mode"), F.when(u % 3 == 0, "now").when(u % 3 == 1, "planned").otherwise("none").alias("kids"),
        F.when(u % 4 == 0, "portable").when(u % 4 == 1, "partly").when(u % 4 == 2, "local").alias("income"), "flights")
    return vis.legacy_answers(saved)


@query("h20_geo_name_clean", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN c_name || ' County' ELSE c_name END AS name FROM customer")
def h20(spark, sf):
    k = F.col("c_custkey") % 5
    suffix = F.when(k == 0, " city").when(k == 1, " CDP").when(k == 2, " unified Government (balance)").when(k == 3, " town (balance)").otherwise(" County")
    return table(spark, sf, "customer").select("c_custkey", clean_name(F.concat("c_name", suffix)).alias("name"))


@query("h21_facts_with_fallback", """
SELECT geo_id, indicator_id, round(value, 6) AS value, 'town' AS from_level FROM s_feats WHERE geo_level = 'place' AND value IS NOT NULL
UNION ALL SELECT t.geo_id, CASE indicator_id WHEN 'nation_balance' THEN 'balance' ELSE indicator_id END AS i, round(value, 6), 'county' FROM h_town t JOIN s_feats f ON f.geo_id = t.county_geoid
WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s_feats o WHERE o.geo_id = t.geo_id AND o.value IS NOT NULL AND o.indicator_id = CASE f.indicator_id WHEN 'nation_balance' THEN 'balance' ELSE f.indicator_id END)""")
def h21(spark, sf):
    # The county's balance stands in for a town's own.
    f = base.features(spark, sf).withColumn("indicator_id", F.when(F.col("indicator_id") == "nation_balance", "balance").otherwise(F.col("indicator_id")))
    return r6(vis.facts_with_fallback(f, base.universe(spark, sf).where("geo_level = 'place'").select("geo_id", "county_geoid")), "value")
