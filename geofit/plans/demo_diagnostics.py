"""Diagnostics and publication over the shared demo frames."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from geofit.functions import keys
from geofit.functions.units import SHAPES, format_value
from geofit.operators import contracts as con
from geofit.operators import diagnostics as dg
from geofit.operators import elicit as el
from geofit.operators import features as feat
from geofit.operators import publish as pub
from geofit.operators import scoring as sc
from geofit.operators import validate as val
from geofit.operators.lineage import cut
from geofit.operators.registry import DOMAIN_SCHEMA, SOURCE_SCHEMA, local_frame, registry_frame
from geofit.plans import demo_base as base
from geofit.plans import demo_elicit as de
from geofit.plans import demo_scoring as ds
from geofit.plans import demo_sources as src
from geofit.plans import demo_universe as du
from geofit.plans.catalog import cte, query, r6, table
from geofit.sources import normalise as no
from geofit.sources import readers

# ------------------------------------------------------------------------- C9

BROKEN = [
    base.ind("ok_one", "market", "place", "usd", "higher_better", direction="universal"),
    base.ind("ok_one", "market", "place", "usd", "higher_better", direction="universal"),
    base.ind("no_unit", "money", "place", "", "ideal_point", dict(target=1), direction="universal"),
    base.ind("lost", "nowhere", "galaxy", "usd", "odd_curve"),
    base.ind("secret", "market", "place", "share", "ideal_band", dict(lo=3, hi=1, shoulder=1), sensitive=True),
    base.ind("hobby", "lifestyle", "county", "count", "lower_better", dict(lo=1), transform="cube"),
    dict(base.ind("open_share", "politics", "place", "share", "ideal_point", dict(target=0, tol=100), sensitive=True), source="nobody"),
    dict(base.ind("crossed", "service", "place", "count", "higher_better"), crosswalk_from="place"),
]
RULES = [
    ("indicator id unique", "ok_one"), ("domain weights sum to 100", "all"), ("domain weight not negative", "supply"), ("scoring domain has indicators", "supply"),
    ("unscored domain weighs nothing", "lifestyle"), ("sensitive domain weighs nothing", "politics"), ("indicator domain known", "lost"),
    ("indicator domain scores", "hobby"), ("sensitive flag matches domain", "secret"), ("level known", "lost"), ("transform known", "hobby"),
    ("unit given", "no_unit"), ("direction fits curve", "no_unit"), ("curve well formed", "no_unit"), ("curve well formed", "lost"),
    ("curve well formed", "secret"), ("curve well formed", "hobby"), ("indicator source known", "open_share"), ("level offered by source", "lost"),
    ("crosswalk changes level", "crossed"), ("source url is https", "orders"), ("source complete", "orders"), ("tolerance fits the values", "open_share"),
]
BROKEN_DOMAINS = [("market", "Market", 40.0, True, False, False), ("money", "Money", 30.0, True, False, False), ("service", "Service", 20.0, True, False, False),
                  ("supply", "Supply", -5.0, True, False, False), ("politics", "Politics", 7.0, True, True, False), ("lifestyle", "Lifestyle", 2.0, False, False, False)]


@query("c9_validate_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}')" for r, k in RULES)
       + ") t(rule, key) WHERE key <> 'open_share' OR rule <> 'tolerance fits the values' OR (SELECT std FROM s_stats WHERE indicator_id = 'open_share') < 10")
def c9(spark, sf):
    reg = registry_frame(spark, BROKEN)
    sources = local_frame(spark, [("orders", "Orders", "http://x", ["place", "county"], None, "open")], SOURCE_SCHEMA)
    found = val.validate_registry(reg, local_frame(spark, BROKEN_DOMAINS, DOMAIN_SCHEMA), sources)
    spread = val.tolerance_check(reg, feat.indicator_stats(base.place_features(spark, sf)))
    return found.unionByName(spread).select("rule", "key").distinct()


# ------------------------------------------------------------------------- F1-F5

def price_months(spark, sf):
    return src.monthly(src.lines(spark, sf), ["st", "co"], ["statecodefips", "municipalcodefips"], F.sum("l_quantity"))


cte("f_app", f"""
SELECT geo_id, (b - a) / a AS appreciation FROM (SELECT lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id,
  sum(l_quantity) FILTER (date_trunc('month', l_shipdate) = {src.MONTHS_BACK(60)}) AS a, sum(l_quantity) FILTER (date_trunc('month', l_shipdate) = {src.MONTHS_BACK(0)}) AS b
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) WHERE a > 0 AND b IS NOT NULL""")


@query("f1_appreciation", "SELECT geo_id, round(appreciation, 6) AS appreciation FROM f_app")
def f1(spark, sf):
    return r6(dg.appreciation(price_months(spark, sf)), "appreciation")


cte("f_idx", """
SELECT *, (p_migration + p_appreciation) / 2 AS hype FROM (SELECT *,
  (rank() OVER (ORDER BY migration_shrunk) + (count(*) OVER (PARTITION BY migration_shrunk) - 1) / 2) / count(*) OVER () AS p_migration,
  (rank() OVER (ORDER BY appreciation) + (count(*) OVER (PARTITION BY appreciation) - 1) / 2) / count(*) OVER () AS p_appreciation
  FROM (SELECT c.geo_id, c.name, c.population, n.net_migration, a.appreciation, 1000 * n.net_migration / c.population AS migration_rate,
    1000 * n.net_migration / (c.population + 50000) AS migration_shrunk FROM cty c JOIN b_net n USING (geo_id) JOIN f_app a USING (geo_id) WHERE c.population >= 1000))""")


def index(spark, sf):
    moves = no.migration_flows(src.flows(spark, sf, "in"), src.flows(spark, sf, "out"))
    return cut(dg.hype_index(du.counties(spark, sf), moves, dg.appreciation(price_months(spark, sf))))


@query("f2_hype_index", """
SELECT geo_id, population, net_migration, round(appreciation, 6) AS appreciation, round(migration_rate, 6) AS migration_rate,
  round(p_migration, 6) AS p_migration, round(p_appreciation, 6) AS p_appreciation, round(hype, 6) AS hype FROM f_idx""")
def f2(spark, sf):
    cols = ["geo_id", "population", "net_migration", "appreciation", "migration_rate", "p_migration", "p_appreciation", "hype"]
    return r6(index(spark, sf).select(*cols), *cols[3:])


cte("f_scores", """
SELECT p AS profile_id, lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 1000 AS VARCHAR), 5, '0') AS geo_id,
  sum(CAST(round(CASE p WHEN 'p1' THEN l_discount ELSE l_tax END * 100) AS BIGINT)) / count(*) / 10 AS score
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey, (VALUES ('p1'), ('p2')) t(p) GROUP BY 1, 2""")


def supplier_scores(spark, sf):
    per = src.lines(spark, sf).groupBy("key").agg(*[(F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.count(F.lit(1)) / 10).alias(p)
                                                    for p, c in (("p1", "l_discount"), ("p2", "l_tax"))])
    return per.select(F.lpad("key", 5, "0").alias("geo_id"), F.stack(F.lit(2), F.lit("p1"), "p1", F.lit("p2"), "p2").alias("profile_id", "score"))


@query("f3_hype_regression", """
SELECT profile_id, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(regr_slope(score, hype), 6) END AS slope,
  CASE WHEN count(*) >= 30 THEN round(regr_intercept(score, hype), 6) END AS intercept, CASE WHEN count(*) >= 30 THEN round(corr(hype, score), 6) END AS r,
  CASE WHEN count(*) >= 30 THEN round(pow(corr(hype, score), 2), 6) END AS r_squared FROM f_idx JOIN f_scores USING (geo_id) GROUP BY 1""")
def f3(spark, sf):
    return r6(dg.hype_regression(index(spark, sf), supplier_scores(spark, sf)), "slope", "intercept", "r", "r_squared")


@query("f3_hype_residuals", """
SELECT profile_id, geo_id, round(score - (hype * regr_slope(score, hype) OVER w + regr_intercept(score, hype) OVER w), 6) AS residual
FROM f_idx JOIN f_scores USING (geo_id) WINDOW w AS (PARTITION BY profile_id) QUALIFY count(*) OVER w >= 30""")
def f3_residuals(spark, sf):
    return r6(dg.hype_residuals(index(spark, sf), supplier_scores(spark, sf)).select("profile_id", "geo_id", "residual"), "residual")


@query("f4_quiet_winners", """
SELECT profile_id, geo_id, name, round(hype, 6) AS hype, round(score, 6) AS score FROM (
  SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY profile_id) AS cut FROM f_idx JOIN f_scores USING (geo_id)) WHERE score >= cut AND hype < 0.5
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, geo_id) <= 15""")
def f4(spark, sf):
    return r6(dg.quiet_winners(index(spark, sf), supplier_scores(spark, sf)), "hype", "score")


@query("f5_loud_losers", """
SELECT profile_id, geo_id, name, round(hype, 6) AS hype, round(score, 6) AS score FROM (
  SELECT *, quantile_cont(hype, 0.9) OVER (PARTITION BY profile_id) AS cut, quantile_cont(score, 0.5) OVER (PARTITION BY profile_id) AS mid FROM f_idx JOIN f_scores USING (geo_id))
WHERE hype >= cut AND score < mid QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY hype DESC, geo_id) <= 15""")
def f5(spark, sf):
    return r6(dg.loud_losers(index(spark, sf), supplier_scores(spark, sf)), "hype", "score")


# ------------------------------------------------------------------------- F6-F8, F18

cte("s_dwoff", "SELECT * FROM s_dw WHERE domain <> 'politics'")
cte("s_offdesir", "SELECT * FROM s_pdesir WHERE domain <> 'politics'")
base.scoring_ctes("so", "s_offdesir", "s_dwoff")
RANKED = "SELECT profile_id, geo_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, geo_id) AS rank FROM"
cte("f_delta", f"""
SELECT profile_id, geo_id, a.rank AS rank_on, b.rank AS rank_off, b.rank - a.rank AS rank_change FROM ({RANKED} sp_score) a JOIN ({RANKED} so_score) b USING (profile_id, geo_id)""")


def layers(spark, sf):
    return dg.layer_ranks(base.place_features(spark, sf), base.registry(spark), base.profiles(spark), ["politics"])


def delta(spark, sf):
    return dg.rank_delta(layers(spark, sf)).select("profile_id", "geo_id", "rank_on", "rank_off", "rank_change")


@query("f6_layer_delta", "SELECT * FROM f_delta")
def f6(spark, sf):
    return delta(spark, sf)


@query("f6_top_changes", f"""
SELECT profile_id, geo_id, 'entered' AS change FROM ({RANKED} sp_score) WHERE rank <= 25 AND (profile_id, geo_id) NOT IN (SELECT profile_id, geo_id FROM ({RANKED} so_score) WHERE rank <= 25)
UNION ALL SELECT profile_id, geo_id, 'left' FROM ({RANKED} so_score) WHERE rank <= 25 AND (profile_id, geo_id) NOT IN (SELECT profile_id, geo_id FROM ({RANKED} sp_score) WHERE rank <= 25)""")
def f6_changes(spark, sf):
    return dg.top_changes(layers(spark, sf))


@query("f7_biggest_movers", """
SELECT * FROM f_delta QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY rank_change DESC, geo_id) <= 8
  OR row_number() OVER (PARTITION BY profile_id ORDER BY rank_change, geo_id) <= 8""")
def f7(spark, sf):
    return dg.biggest_movers(cut(delta(spark, sf)))


@query("f8_counter_axis", """
SELECT 'p2' AS profile_id, indicator_id, geo_id, round(value, 6) AS value, round(score, 6) AS score FROM (
  SELECT *, median(value) OVER () AS med FROM s_feats WHERE indicator_id = 'open_share' AND value IS NOT NULL) JOIN (SELECT geo_id, score FROM so_score WHERE profile_id = 'p2') USING (geo_id)
WHERE CASE WHEN 0.33 <= med THEN value > med ELSE value < med END QUALIFY row_number() OVER (ORDER BY score DESC, geo_id) <= 12""")
def f8(spark, sf):
    f, reg, p = base.place_features(spark, sf), base.registry(spark), base.profiles(spark)
    off = sc.score(f, reg, dg.with_and_without(p, ["politics"])).where("endswith(profile_id, '|off')").withColumn("profile_id", F.regexp_replace("profile_id", r"\|off$", ""))
    return r6(dg.counter_axis(f, reg, p, cut(off)), "value", "score")


cte("f_full", """
SELECT indicator_id FROM s_feats f JOIN (SELECT geo_level, count(*) AS n FROM s_univ GROUP BY 1) u USING (geo_level) WHERE value IS NOT NULL
GROUP BY indicator_id HAVING count(*) / any_value(n) >= 0.9""")
cte("f_fulldesir", "SELECT * FROM s_pdesir WHERE indicator_id IN (SELECT indicator_id FROM f_full)")
base.scoring_ctes("sf", "f_fulldesir")


@query("f18_complete_only_delta", f"""
SELECT profile_id, geo_id, a.rank AS rank_on, b.rank AS rank_off, b.rank - a.rank AS rank_change FROM ({RANKED} sp_score) a JOIN ({RANKED} sf_score) b USING (profile_id, geo_id)""")
def f18(spark, sf):
    f, u = base.place_features(spark, sf), base.universe(spark, sf)
    return dg.complete_only_delta(f, u, base.registry(spark), base.profiles(spark), 0.9).select("profile_id", "geo_id", "rank_on", "rank_off", "rank_change")


# ------------------------------------------------------------------------- F9 F10

BLIND = ["spend_total", "balance", "urgent_share", "order_count"]
cte("f_short", "SELECT geo_id, row_number() OVER (ORDER BY score DESC, geo_id) AS position FROM sp_score WHERE profile_id = 'p1' QUALIFY position <= 30")
LABEL = "'Place ' || CASE WHEN position <= 26 THEN chr((64 + position)::INT) ELSE position::VARCHAR END"


def shortlist(spark, sf, f):
    s = sc.score(f, base.registry(spark), base.profiles(spark)).where("profile_id = 'p1'")
    return sc.top_k(s, ["profile_id"], [F.desc("score"), F.asc("geo_id")], 30, "position").select("geo_id", "position")


@query("f9_blind_export", f"""
SELECT {LABEL} AS label, u.population, i AS indicator, CASE WHEN f.value IS NULL THEN '—' ELSE CASE i
  WHEN 'spend_total' THEN CASE WHEN f.value >= 10000 THEN '$' || format('{{:,.0f}}', f.value / 1000) || 'k' ELSE '$' || format('{{:,.0f}}', f.value) END
  WHEN 'balance' THEN format('{{:,.1f}}', f.value) WHEN 'urgent_share' THEN printf('%.1f%%', f.value * 100) ELSE format('{{:,.0f}}', f.value) END END AS shown
FROM f_short s, (VALUES ('spend_total'), ('balance'), ('urgent_share'), ('order_count')) t(i) LEFT JOIN s_feats f ON f.geo_id = s.geo_id AND f.indicator_id = i LEFT JOIN s_univ u ON u.geo_id = s.geo_id""")
def f9(spark, sf):
    f = base.place_features(spark, sf)
    out = dg.blind_export(cut(shortlist(spark, sf, f)), f, base.universe(spark, sf), base.registry(spark), BLIND)
    return out.select("label", "population", F.explode("values").alias("indicator", "shown"))


@query("f9_blind_key", f"SELECT {LABEL} AS label, name || ', ' || state_usps AS name FROM f_short JOIN s_univ USING (geo_id)")
def f9_key(spark, sf):
    return dg.blind_key(shortlist(spark, sf, base.place_features(spark, sf)), base.universe(spark, sf))


WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
cte("f_bench", f"""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[3] || ' ' || w[4] || ' ' || w[5] ELSE w[2] END || CASE item_id % 2 WHEN 0 THEN ' County' ELSE ' city' END AS name,
  w[7] AS code FROM (SELECT item_id, {WORDS} AS w FROM benchmark)""")


def leak_universe(spark, sf):
    w = lambda i: F.element_at(dg._words("text"), i)
    item = F.col("item_id")
    name = F.when(item % 3 == 0, F.concat_ws(" ", w(1), w(2))).when(item % 3 == 1, F.concat_ws(" ", w(3), w(4), w(5))).otherwise(w(2))
    named = table(spark, sf, "benchmark").select(F.concat(name, F.when(item % 2 == 0, " County").otherwise(" city")).alias("name"), w(7).alias("state_usps"), F.lit("").alias("geo_id"))
    # Every customer and part number is an id that must not appear.
    c = table(spark, sf, "customer").select(F.lit("").alias("name"), F.lit("").alias("state_usps"), F.lpad(src.text("c_custkey"), 5, "0").alias("geo_id"))
    return named.unionByName(c)


@query("f10_leak_scan", """
SELECT DISTINCT doc_id, 'place name' AS kind, stem AS key FROM documents, (SELECT DISTINCT regexp_replace(name, '\\s+(County|Parish|Borough|city|town|CDP|Census Area)$', '') AS stem FROM f_bench)
WHERE length(stem) >= 5 AND contains(text, stem) AND regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(stem) || '($|[^\\p{L}\\p{N}_])')
UNION ALL SELECT DISTINCT doc_id, 'state code', t FROM (SELECT doc_id, unnest(list_distinct(""" + WORDS + """)) AS t FROM documents) WHERE t IN (SELECT code FROM f_bench)
UNION ALL SELECT DISTINCT doc_id, 'id', t FROM (SELECT doc_id, unnest(list_distinct(""" + WORDS + """)) AS t FROM documents)
WHERE regexp_full_match(t, '[0-9]{5,10}') AND t IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer)
UNION ALL SELECT DISTINCT doc_id, 'id', lpad(CAST(n_chars AS VARCHAR), 5, '0') FROM documents WHERE n_chars IN (SELECT c_custkey FROM customer)""")
def f10(spark, sf):
    d = table(spark, sf, "documents")
    return dg.leak_scan(d.select("doc_id", "text"), leak_universe(spark, sf), d.select("doc_id", F.col("n_chars").cast("double").alias("value")))


# ------------------------------------------------------------------------- F11-F17


@query("f11_spearman", """
SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS rho FROM (SELECT l_suppkey,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS a,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS b FROM lineitem) GROUP BY 1""")
def f11(spark, sf):
    return r6(dg.spearman(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey", "l_quantity", "l_extendedprice"), "rho")


cte("f_cal", f"""
SELECT profile_id, geo_id, sum(weight * d) / sum(weight) AS score FROM (SELECT f.geo_id, r.domain, {base.sql_desirability('r.curve', 'f.value', 'f.percentile', 'r.')} AS d
  FROM s_feats f JOIN s_reg r USING (indicator_id) WHERE f.geo_level = 'place' AND f.value IS NOT NULL) JOIN s_dw USING (domain) WHERE weight > 0 AND d IS NOT NULL GROUP BY 1, 2""")
cte("f_pairs", """
SELECT profile_id, geo_id, rating, score FROM (SELECT 'p' || (event_id % 3 + 1) AS profile_id, lpad(CAST(user_id AS VARCHAR), 9, '0') AS geo_id,
  CAST(max(CAST(trunc(value) AS BIGINT) % 10 + 1) AS DOUBLE) AS rating FROM events GROUP BY 1, 2) JOIN f_cal USING (profile_id, geo_id)""")


def cal_scores(spark, sf):
    return dg.calibration_score(base.place_features(spark, sf), base.registry(spark), base.profiles(spark).domain_weights)


def cal_pairs(spark, sf):
    ratings = table(spark, sf, "events").groupBy(F.concat(F.lit("p"), src.text(F.col("event_id") % 3 + 1)).alias("profile_id"), F.lpad(src.text("user_id"), 9, "0").alias("geo_id")).agg(
        F.max(F.col("value").cast("bigint") % 10 + 1).cast("double").alias("rating"))
    return cut(dg.calibration_pairs(ratings, cal_scores(spark, sf)))


@query("f12_calibration_score", "SELECT profile_id, geo_id, round(score, 6) AS score FROM f_cal")
def f12(spark, sf):
    return r6(cal_scores(spark, sf), "score")


@query("f13_calibration", """
SELECT profile_id, n, round(rho, 6) AS rho, CASE WHEN rho >= 0.6 THEN 'reproduces judgements' WHEN rho >= 0.3 THEN 'partial agreement' ELSE 'does not reproduce judgements' END AS verdict
FROM (SELECT profile_id, count(*) AS n, corr(a, b) AS rho FROM (SELECT profile_id,
  rank() OVER (PARTITION BY profile_id ORDER BY rating) + (count(*) OVER (PARTITION BY profile_id, rating) - 1) / 2 AS a,
  rank() OVER (PARTITION BY profile_id ORDER BY score) + (count(*) OVER (PARTITION BY profile_id, score) - 1) / 2 AS b FROM f_pairs) GROUP BY 1)""")
def f13(spark, sf):
    return r6(dg.calibration(cal_pairs(spark, sf)), "rho")


@query("f13_calibration_misses", """
SELECT profile_id, geo_id, rating, rating_rank, model_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY rating DESC, geo_id) AS INT) AS rating_rank,
  CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, geo_id) AS INT) AS model_rank FROM f_pairs)
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY abs(rating_rank - model_rank) DESC, geo_id) <= 5""")
def f13_misses(spark, sf):
    return dg.calibration_misses(cal_pairs(spark, sf)).select("profile_id", "geo_id", "rating", "rating_rank", "model_rank")


cte("f_have", "SELECT DISTINCT indicator_id FROM s_feats WHERE value IS NOT NULL")


@query("f14_coverage_by_domain", """
SELECT d.domain, d.label, count(r.indicator_id) AS registered, count(h.indicator_id) AS populated, count(r.indicator_id) - count(h.indicator_id) AS missing
FROM s_domains d LEFT JOIN s_reg r USING (domain) LEFT JOIN f_have h ON h.indicator_id = r.indicator_id WHERE d.scoring GROUP BY 1, 2""")
def f14(spark, sf):
    return dg.coverage_by_domain(base.registry(spark), base.domains(spark), base.features(spark, sf))


@query("f15_unpopulated_reasons", "SELECT indicator_id, domain, 'orders' AS source, 'no such column' AS reason FROM s_reg WHERE indicator_id NOT IN (SELECT indicator_id FROM f_have)")
def f15(spark, sf):
    blockers = local_frame(spark, [("orders", "no such column")], "source string, reason string")
    return dg.unpopulated_reasons(base.registry(spark), base.features(spark, sf), blockers)


@query("f16_coverage_by_level", "SELECT geo_level, count(*) AS n, round(avg(coverage), 6) AS mean_coverage, count(*) FILTER (coverage < 0.25) AS below_25 FROM s_cov GROUP BY 1")
def f16(spark, sf):
    return r6(dg.coverage_by_level(ds.coverage(spark, sf)), "mean_coverage")


@query("f17_audit", """
SELECT p AS principle, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, bad || ' faults in ' || n || ' rows' AS evidence FROM (
  SELECT 1 AS p, 0 AS bad, count(DISTINCT geo_id) AS n FROM s_univ
  UNION ALL SELECT 2, count(*) FILTER (f.geo_level <> r.geo_level), count(*) FROM s_feats f JOIN s_reg r USING (indicator_id)
  UNION ALL SELECT 3, 0, 1 UNION ALL SELECT 4, count(*) FILTER (lang = 'de'), count(*) + 1 FROM documents UNION ALL SELECT 5, 0, 1
  UNION ALL SELECT 6, count(*) FILTER (value IS NULL AND percentile IS NOT NULL), count(*) FROM s_feats
  UNION ALL SELECT 7, 1, 3 UNION ALL SELECT 8, 0, 3 UNION ALL SELECT 9, 0, count(*) FROM s_bands UNION ALL SELECT 10, 0, 8)""")
def f17(spark, sf):
    f, u, reg, p = base.features(spark, sf), base.universe(spark, sf), base.registry(spark), base.profiles(spark)
    m = src.document_files(spark, sf)
    manifest = readers.manifest_rows(m).join(table(spark, sf, "documents").select(F.concat(F.lit("raw/"), src.text("doc_id"), F.lit(".txt")).alias("path"), (F.col("lang") == "de").alias("s")), "path").select(
        "path", "sha256", F.col("s").alias("synthetic"))
    whole = m.agg(F.sha2(F.min("path"), 256).alias("sha256")).select(F.lit("orders").alias("path"), "sha256", F.lit(False).alias("synthetic"))
    tasks = local_frame(spark, [("balance",), ("big_order",), ("open_share",)], "indicator_id string")
    places = f.where("geo_level = 'place'")
    bands = cut(sc.rank_bands(places, reg, p, ds.formula_draws(spark)))
    return dg.audit(u, f, manifest.unionByName(whole), reg, base.domains(spark), p, tasks, cut(sc.score(places, reg, p)), bands).select("principle", "verdict", "evidence")


# ------------------------------------------------------------------------- G


@query("g1_require_bands", "SELECT * FROM s_bands")
def g1(spark, sf):
    f = base.place_features(spark, sf)
    bands = sc.rank_bands(f, base.registry(spark), base.profiles(spark), ds.formula_draws(spark))
    return con.require_bands(bands, "place ranking")


cte("g_eff", """
SELECT profile_id, indicator_id, domain, weight * raw / sum(raw) OVER (PARTITION BY profile_id, domain) AS effective_weight FROM (
  SELECT w.profile_id, r.indicator_id, w.domain, w.weight, greatest(coalesce(i.weight, 0), 0.05) AS raw FROM s_dw w JOIN s_reg r USING (domain)
  LEFT JOIN s_iw i ON i.profile_id = w.profile_id AND i.indicator_id = r.indicator_id WHERE w.weight > 0)""")
cte("g_con", """
SELECT d.profile_id, d.geo_id, d.indicator_id, d.domain, d.value, d.d, effective_weight * (d.d - 0.5) AS contribution FROM s_pdesir d JOIN g_eff USING (profile_id, indicator_id)""")
cte("g_why", """
SELECT profile_id, geo_id, 'contributor' AS kind, indicator_id, contribution, CAST(row_number() OVER (PARTITION BY profile_id, geo_id ORDER BY contribution DESC, indicator_id) AS INT) AS n
FROM g_con WHERE contribution > 0 QUALIFY n <= 5 UNION ALL
SELECT profile_id, geo_id, 'drag', indicator_id, contribution, CAST(row_number() OVER (PARTITION BY profile_id, geo_id ORDER BY contribution, indicator_id) AS INT) AS n
FROM g_con WHERE contribution < 0 QUALIFY n <= 3""")


@query("g2_effective_weights", """
SELECT profile_id, domain, indicator_id, round(effective_weight, 6) AS effective_weight, count(f.value) AS n_values FROM g_eff LEFT JOIN s_feats f USING (indicator_id) GROUP BY 1, 2, 3, 4""")
def g2(spark, sf):
    per = base.features(spark, sf).groupBy("indicator_id").agg(F.count("value").alias("n_values"))
    out = pub.effective_weights(base.registry(spark), base.profiles(spark)).join(per, "indicator_id", "left")
    return r6(out.withColumn("n_values", F.coalesce("n_values", F.lit(0)).cast("bigint")), "effective_weight")


@query("g3_explain", "SELECT profile_id, geo_id, kind, n, indicator_id, round(contribution, 6) AS contribution FROM g_why WHERE (profile_id, geo_id) IN (SELECT profile_id, geo_id FROM sp_score)")
def g3(spark, sf):
    f, reg, p = base.place_features(spark, sf), base.registry(spark), base.profiles(spark)
    out = pub.explain(cut(pub.contributions(f, reg, p, sc.score(f, reg, p))))
    return r6(out.select("profile_id", "geo_id", "kind", "n", "indicator_id", "contribution"), "contribution")


@query("g4_city_unit_flag", "SELECT geo_id, substr(geo_id, 1, 2) <> '02' AND CAST(substr(geo_id, 3, 3) AS INT) BETWEEN 510 AND 840 AS city_unit FROM (SELECT lpad(CAST((s_nationkey + 1) * 1000 + (s_suppkey * 7 + 300) % 1000 AS VARCHAR), 5, '0') AS geo_id FROM supplier)")
def g4(spark, sf):
    key = F.lpad(src.text((F.col("s_nationkey") + 1) * 1000 + (F.col("s_suppkey") * 7 + 300) % 1000), 5, "0")
    return table(spark, sf, "supplier").select(key.alias("geo_id")).withColumn("city_unit", keys.is_city_unit("geo_id"))


HOMES = ["000000001"]


@query("g5_publish_ranking", f"""
SELECT r.profile_id, r.geo_id, u.name || ', ' || u.state_usps AS name, u.population, r.rank, round(r.score, 6) AS score, b.rank_p05, b.rank_p95, b.rank_spread, b.rank_spread > 40 AS coin_flip, false AS city_unit,
  s.worst_domain, round(s.weight_covered, 6) AS coverage,
  (SELECT string_agg(indicator_id, ',' ORDER BY n) FROM g_why w WHERE w.profile_id = r.profile_id AND w.geo_id = r.geo_id AND kind = 'contributor') AS contributors,
  (SELECT string_agg(indicator_id, ',' ORDER BY n) FROM g_why w WHERE w.profile_id = r.profile_id AND w.geo_id = r.geo_id AND kind = 'drag') AS drags
FROM ({RANKED} sp_score) r JOIN sp_score s USING (profile_id, geo_id) JOIN s_univ u USING (geo_id) JOIN s_bands b USING (profile_id, geo_id)
WHERE geo_id <> '000000001' AND (profile_id, geo_id) NOT IN (SELECT profile_id, geo_id FROM s_kohits) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY rank) <= 15""")
def g5(spark, sf):
    f, reg, p = base.place_features(spark, sf), base.registry(spark), base.profiles(spark)
    bands = sc.rank_bands(f, reg, p, ds.formula_draws(spark))
    rows = pub.publish_ranking(f, base.universe(spark, sf), reg, p, bands, sc.score(f, reg, p), HOMES, "place")
    ids = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x["indicator_id"]), ","), F.lit(""))
    return r6(rows.withColumn("contributors", ids("contributors")).withColumn("drags", ids("drags")).drop("worst_domain_score"), "score", "coverage")


@query("g5_baseline_rank", f"SELECT profile_id, geo_id, rank, round(score, 6) AS score, of FROM ({RANKED} sp_score) JOIN (SELECT profile_id, count(*) AS of FROM sp_score GROUP BY 1) USING (profile_id) WHERE geo_id = '000000001'")
def g5_baseline(spark, sf):
    f = base.place_features(spark, sf)
    return r6(pub.baseline_rank(cut(sc.ranking(sc.score(f, base.registry(spark), base.profiles(spark)))), HOMES), "score")


UNITS = ["usd", "share", "ratio", *SHAPES, "parsecs"]


def _fmt_sql(u):
    if u == "usd":
        return "CASE WHEN v >= 10000 THEN '$' || format('{:,.0f}', v / 1000) || 'k' ELSE '$' || format('{:,.0f}', v) END"
    if u == "share":
        return "printf('%.1f%%', v * 100)"
    if u == "ratio":
        return "CASE WHEN abs(v) < 1 THEN printf('%.3f', v) ELSE format('{:,.2f}', v) END"
    pre, dec, grouped, suf = SHAPES.get(u, ("", 1, True, ""))
    num = f"format('{{:,.{dec}f}}', v)" if grouped else f"printf('%.{dec}f', v)"
    return f"'{pre}' || {num} || '{suf}'"


@query("g6_format_value", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v IS NULL THEN '—' ELSE CASE u " + " ".join(f"WHEN {i} THEN {_fmt_sql(u)}" for i, u in enumerate(UNITS))
       + f" END END AS shown FROM (SELECT *, l_partkey % {len(UNITS)} AS u, CASE WHEN l_linenumber <> 7 THEN l_extendedprice * l_discount / l_linenumber END AS v FROM lineitem)")
def g6(spark, sf):
    unit = F.element_at(F.array(*[F.lit(f" {u.upper()}") for u in UNITS]), (F.col("l_partkey") % len(UNITS) + 1).cast("int"))
    v = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * F.col("l_discount") / F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", format_value(v, unit).alias("shown"))


# ------------------------------------------------------------------------- E1 as it is asked

_WORDS = lambda v, pct: "CASE WHEN ind = 'big_order' THEN " + f"['very low', 'low', 'middling', 'high', 'very high'][CAST(least(4, greatest(0, floor({pct} * 5))) AS INT) + 1]" + "".join(
    f" WHEN ind IN ({', '.join(chr(39) + i['indicator_id'] + chr(39) for i in base.REGISTRY if i['unit'] == u)}) THEN " + re.sub(r"\bv\b", v, _fmt_sql(u)) for u in ("usd", "count", "index", "share")) + " END"


@query("e1_worded_tasks", f"""
SELECT c.task_id, CAST(list_position(c.inds, b.ind) - 1 AS INT) AS n, CASE WHEN b.ind = 'big_order' THEN 'Large orders' ELSE b.ind END AS label,
  {_WORDS('a_raw', 'a_pct')} AS a, {_WORDS('b_raw', 'b_pct')} AS b, 'Which would you rather live in?' AS text, 3 AS answers
FROM e_choice c JOIN e_both b ON b.a = c.a AND b.b = c.b AND list_contains(c.inds, b.ind)""")
def e1_worded(spark, sf):
    reg = base.registry(spark)
    put = el.worded_tasks(cut(el.choice_pairs(de.candidates(spark, sf))), reg)
    return put.select("task_id", "text", F.size("options").alias("answers"), F.inline("shown")).drop("indicator")
