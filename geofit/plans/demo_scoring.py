"""Feature and scoring operators over the shared demo frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.functions import curves
from geofit.operators import features as feat
from geofit.operators import registry as regs
from geofit.operators import scoring as sc
from geofit.plans import demo_base as base
from geofit.plans.catalog import cte, query, r6, table

HOME = ["000000001", "00001"]
HOME_SQL = "('000000001', '00001')"


def trimmed(df):
    return r6(df.select("geo_level", "geo_id", "indicator_id", "value", "value_transformed", "percentile"),
              "value", "value_transformed", "percentile")


# ------------------------------------------------------------------------- C features


@query("c1_transform", "SELECT geo_level, geo_id, indicator_id, round(value_transformed, 6) AS value_transformed FROM s_trans")
def c1(spark, sf):
    joined = feat.universe_join(base.facts(spark, sf), base.universe(spark, sf))
    out = feat.add_transform(joined, base.registry(spark))
    return r6(out.select("geo_level", "geo_id", "indicator_id", "value_transformed"), "value_transformed")


@query("c2_percentile_avg_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((r + (ties - 1) / 2 - 1) / (n - 1), 6) AS percentile FROM (
  SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r,
    count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS ties, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)""")
def c2(spark, sf):
    li = table(spark, sf, "lineitem")
    return r6(feat.add_percentile(li, "l_quantity", ["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "percentile"), "percentile")


@query("c3_universe_join", "SELECT geo_level, geo_id, indicator_id, round(value, 6) AS value, population FROM s_facts JOIN s_univ USING (geo_level, geo_id)")
def c3(spark, sf):
    out = feat.universe_join(base.facts(spark, sf), base.universe(spark, sf))
    return r6(out.select("geo_level", "geo_id", "indicator_id", "value", "population"), "value")


@query("c3_dropped_facts", """
SELECT indicator_id, count(*) AS n_dropped FROM s_facts f WHERE NOT EXISTS (
  SELECT 1 FROM s_univ u WHERE u.population > 0 AND u.geo_level = f.geo_level AND u.geo_id = f.geo_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def c3_dropped(spark, sf):
    return feat.dropped_facts(base.facts(spark, sf), base.universe(spark, sf).where("population > 0"))


cte("s_cov", """
SELECT geo_level, geo_id, name, coalesce(p, 0) AS indicators_present, coalesce(a, 0) AS indicators_applicable,
  CASE WHEN a > 0 THEN coalesce(p, 0) / a END AS coverage
FROM s_univ LEFT JOIN (SELECT geo_level, geo_id, count(DISTINCT indicator_id) AS p FROM s_feats WHERE value IS NOT NULL GROUP BY 1, 2) USING (geo_level, geo_id)
  LEFT JOIN (SELECT geo_level, count(*) AS a FROM s_reg GROUP BY 1) USING (geo_level)""")


def coverage(spark, sf):
    return feat.coverage(base.features(spark, sf), base.universe(spark, sf), base.registry(spark))


@query("c4_coverage", "SELECT geo_level, geo_id, name, indicators_present, indicators_applicable, round(coverage, 6) AS coverage FROM s_cov")
def c4(spark, sf):
    return r6(coverage(spark, sf), "coverage")


@query("c5_baseline_compare", f"""
SELECT geo_level, geo_id, indicator_id, round(f.value, 6) AS value, round(b.value, 6) AS baseline_value, round(b.percentile, 6) AS baseline_percentile,
  round(f.percentile - b.percentile, 6) AS vs_baseline
FROM s_feats f LEFT JOIN (SELECT geo_level, indicator_id, value, percentile FROM s_feats WHERE geo_id IN {HOME_SQL}) b USING (geo_level, indicator_id)""")
def c5(spark, sf):
    out = feat.baseline_compare(base.features(spark, sf), HOME).select(
        "geo_level", "geo_id", "indicator_id", "value", "baseline_value", "baseline_percentile", "vs_baseline")
    return r6(out, "value", "baseline_value", "baseline_percentile", "vs_baseline")


PIVOT = ["balance", "big_order", "urgent_share"]


@query("c6_wide_pivot", "SELECT geo_id, " + ", ".join(
    f"round(max(value) FILTER (indicator_id = '{i}'), 6) AS {i}, round(max(percentile) FILTER (indicator_id = '{i}'), 6) AS {i}__pct" for i in PIVOT)
    + " FROM s_feats WHERE indicator_id IN ('balance', 'big_order', 'urgent_share') GROUP BY 1")
def c6(spark, sf):
    out = feat.wide_pivot(base.place_features(spark, sf), PIVOT)
    return r6(out, *[c for c in out.columns if c != "geo_id"])


@query("c7_build_features", """
SELECT geo_level, geo_id, indicator_id, round(value, 6) AS value, round(value_transformed, 6) AS value_transformed, round(percentile, 6) AS percentile FROM s_feats""")
def c7(spark, sf):
    return trimmed(base.features(spark, sf))


@query("c7_feature_report", """
SELECT (SELECT count(*) FROM s_facts) AS rows_in, count(*) AS rows_joined, (SELECT count(*) FROM s_facts) - count(*) AS rows_dropped_no_geo,
  count(DISTINCT indicator_id) AS indicators_seen, count(*) FILTER (value IS NULL) AS null_values FROM s_feats""")
def c7_report(spark, sf):
    return feat.feature_report(base.facts(spark, sf), base.features(spark, sf))


cte("s_stats", """
SELECT indicator_id, min(value) AS floor, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM s_feats WHERE value IS NOT NULL GROUP BY 1""")


@query("c8_indicator_stats", "SELECT indicator_id, round(floor, 4) AS floor, round(mean, 4) AS mean, round(std, 4) AS std FROM s_stats")
def c8(spark, sf):
    return r6(feat.indicator_stats(base.features(spark, sf)), "floor", "mean", "std", places=4)


# ------------------------------------------------------------------------- D scoring

P = "profile_id, geo_id"


@query("d1_monotone_curves", """
SELECT geo_id, indicator_id, round(least(1, greatest(0, percentile)), 6) AS higher, round(least(1, greatest(0, 1 - percentile)), 6) AS lower
FROM s_feats WHERE percentile IS NOT NULL""")
def d1(spark, sf):
    f = base.features(spark, sf).where("percentile is not null")
    return r6(f.select("geo_id", "indicator_id", curves.higher_better(F.col("percentile")).alias("higher"),
                       curves.lower_better(F.col("percentile")).alias("lower")), "higher", "lower")


@query("d2_curve_band", """
SELECT p_partkey, round(CASE WHEN p_size BETWEEN 15 AND 25 THEN 1 WHEN p_size < 15 THEN greatest(0, 1 - (15 - p_size) / 9.0::DOUBLE)
  ELSE greatest(0, 1 - (p_size - 25) / 30.0::DOUBLE) END, 6)::DOUBLE AS d FROM part""")
def d2(spark, sf):
    p = curves.params(lo=15, hi=25, shoulder=9, shoulder_hi=30)
    return r6(table(spark, sf, "part").select("p_partkey", curves.ideal_band(F.col("p_size").cast("double"), p).alias("d")), "d")


@query("d3_curve_point", "SELECT p_partkey, round(exp(-pow((p_retailprice - 1200) / 400, 2)), 6) AS d FROM part")
def d3(spark, sf):
    p = curves.params(target=1200, tol=400)
    return r6(table(spark, sf, "part").select("p_partkey", curves.ideal_point(F.col("p_retailprice"), p).alias("d")), "d")


@query("d4_desirability", f"""
SELECT geo_id, indicator_id, round({base.sql_desirability('r.curve', 'f.value', 'f.percentile', 'r.')}, 6)::DOUBLE AS d
FROM s_feats f JOIN s_reg r USING (indicator_id)""")
def d4(spark, sf):
    f = base.features(spark, sf).join(base.registry(spark).select("indicator_id", "curve", "params"), "indicator_id")
    return r6(f.select("geo_id", "indicator_id", curves.desirability().alias("d")), "d")


@query("d5_attach_desirability", "SELECT profile_id, domain, geo_id, indicator_id, round(d, 6) AS d, iw FROM s_pdesir")
def d5(spark, sf):
    used, variants = sc.domain_variants(sc.profile_view(base.registry(spark), base.profiles(spark)))
    out = sc.attach_desirability(base.place_features(spark, sf), variants).join(used.select("profile_id", "variant_id"), "variant_id")
    return r6(out.select("profile_id", "domain", "geo_id", "indicator_id", F.col("desirability").alias("d"), "iw"), "d")


@query("d6_sensitive_gate", """
SELECT profile_id, indicator_id, count(*) AS n_places FROM (SELECT DISTINCT profile_id FROM s_dw) p, (SELECT indicator_id FROM s_reg WHERE sensitive) r
  JOIN (SELECT geo_id, indicator_id FROM s_feats) f USING (indicator_id)
WHERE (profile_id, indicator_id) NOT IN (SELECT profile_id, indicator_id FROM s_oi) GROUP BY 1, 2""")
def d6(spark, sf):
    gone = sc.excluded_sensitive(base.registry(spark), base.profiles(spark))
    per = base.features(spark, sf).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n_places"))
    return gone.join(per, "indicator_id").select("profile_id", "indicator_id", "n_places")


def place_scores(spark, sf):
    return sc.domain_scores(base.place_features(spark, sf), base.registry(spark), base.profiles(spark))


@query("d7_domain_scores", "SELECT profile_id, geo_id, domain, round(d, 6) AS d FROM sp_dom")
def d7(spark, sf):
    return r6(place_scores(spark, sf).select("profile_id", "geo_id", "domain", "d"), "d")


@query("d8_influence_target", "SELECT profile_id, round(avg(std), 6) AS target FROM sp_stat WHERE n > 1 AND std > 0 GROUP BY 1")
def d8(spark, sf):
    stats = sc.influence_stats(place_scores(spark, sf), ["profile_id", "domain"])
    return r6(sc.influence_target(stats, ["profile_id"]), "target")


@query("d9_influence_scale", "SELECT profile_id, domain, round(k, 6) AS k, round(centre, 6) AS centre FROM sp_infl")
def d9(spark, sf):
    return r6(sc.influence_scale(place_scores(spark, sf)), "k", "centre")


SCORE_COLS = """profile_id, geo_id, round(score, 6) AS score, worst_domain, round(worst_domain_score, 6) AS worst_domain_score,
  round(weight_covered, 6) AS weight_covered"""


def rounded(df):
    return r6(df, "score", "worst_domain_score", "weight_covered")


@query("d10_combine_domains", f"SELECT {SCORE_COLS} FROM sp_comb")
def d10(spark, sf):
    return rounded(sc.score_all(base.place_features(spark, sf), base.registry(spark), base.profiles(spark)))


def scored_places(spark, sf):
    return sc.score(base.place_features(spark, sf), base.registry(spark), base.profiles(spark))


def scored_counties(spark, sf):
    return sc.score(base.county_features(spark, sf), base.registry(spark), base.profiles(spark))


@query("d11_score", f"SELECT {SCORE_COLS} FROM sp_score")
def d11(spark, sf):
    return rounded(scored_places(spark, sf))


@query("d11_score_warnings", """
SELECT 'p6' AS profile_id, 'no positive domain weights' AS kind, '' AS key, 1::BIGINT AS n
UNION ALL SELECT p, 'sensitive indicators excluded', k, len(string_split(k, ', '))
  FROM (VALUES ('p1', 'nation_open, open_share'), ('p3', 'nation_open, open_share'), ('p4', 'nation_open, open_share'), ('p6', 'nation_open, open_share')) t(p, k)
UNION ALL SELECT profile_id, 'domain has weight but no data', domain, 1 FROM (SELECT * FROM s_dw UNION ALL VALUES ('p4', 'ghosts', 60.0), ('p4', 'money', 40.0))
  WHERE weight > 0 AND domain NOT IN (SELECT DISTINCT domain FROM sp_dom WHERE domain IS NOT NULL)
UNION ALL SELECT profile_id, 'candidates below the coverage floor', '', count(*) FROM sp_comb WHERE weight_covered < 0.8 GROUP BY 1
UNION ALL SELECT 'p4', 'candidates below the coverage floor', '', count(DISTINCT geo_id) FROM s_feats
  WHERE geo_level = 'place' AND indicator_id IN ('balance', 'big_order') AND value IS NOT NULL""")
def d11_warnings(spark, sf):
    weights = base.DOMAIN_WEIGHTS + [("p4", "ghosts", 60), ("p4", "money", 40), ("p6", "money", 0)]
    p = regs.profiles_from_rows(spark, weights, base.INDICATOR_WEIGHTS, base.OVERRIDES, base.OPT_INS)
    return sc.score_warnings(base.place_features(spark, sf), base.registry(spark), p)


cte("s_korules", """
SELECT k.*, TRY_CAST(k.value AS DOUBLE) AS threshold, CASE WHEN TRY_CAST(k.value AS DOUBLE) IS NULL THEN 'skipped: not a number'
  WHEN k.indicator_id NOT IN (SELECT indicator_id FROM s_feats WHERE value IS NOT NULL) THEN 'skipped: no data' ELSE 'applied' END AS status FROM s_ko k""")
cte("s_kohits", """
SELECT s.profile_id, s.geo_id, any_value(s.score) AS score, min(k.rule_no) AS rule_no FROM sp_score s JOIN s_korules k ON k.profile_id = s.profile_id AND status = 'applied'
  JOIN s_feats f ON f.geo_id = s.geo_id AND f.indicator_id = k.indicator_id
WHERE CASE k.op WHEN 'max' THEN f.value > threshold ELSE f.value < threshold END GROUP BY 1, 2""")


@query("d12_knockouts", f"SELECT {P}, round(score, 6) AS score FROM sp_score s WHERE NOT EXISTS (SELECT 1 FROM s_kohits h WHERE h.profile_id = s.profile_id AND h.geo_id = s.geo_id)")
def d12(spark, sf):
    f, reg, p = base.place_features(spark, sf), base.registry(spark), base.profiles(spark)
    out = sc.apply_knockouts(sc.score(f, reg, p), f, p.knockouts)
    return r6(out.select("profile_id", "geo_id", "score"), "score")


@query("d12_knockout_report", """
SELECT r.profile_id, r.rule_no, r.indicator_id, r.op, r.threshold, r.status, CASE WHEN status = 'applied' THEN coalesce(removed, 0) END AS removed, u.name AS best_removed
FROM s_korules r LEFT JOIN (SELECT profile_id, rule_no, count(*) AS removed, arg_min(geo_id, struct_pack(s := -score, g := geo_id)) AS best
  FROM s_kohits GROUP BY 1, 2) h USING (profile_id, rule_no) LEFT JOIN s_univ u ON u.geo_id = h.best""")
def d12_report(spark, sf):
    f, reg, p = base.place_features(spark, sf), base.registry(spark), base.profiles(spark)
    return sc.knockout_report(sc.score(f, reg, p), f, p.knockouts, base.universe(spark, sf))


@query("d13_joint_score", """
SELECT a.geo_id, round(a.score, 6) AS score_a, round(b.score, 6) AS score_b, round(sqrt(a.score * b.score), 6) AS score_joint, round(abs(a.score - b.score), 6) AS disagreement
FROM sp_score a JOIN sp_score b ON b.geo_id = a.geo_id AND b.profile_id = 'p2' WHERE a.profile_id = 'p1'""")
def d13(spark, sf):
    s = scored_places(spark, sf)
    out = sc.joint_score(s.where("profile_id = 'p1'"), s.where("profile_id = 'p2'"))
    return r6(out, "score_a", "score_b", "score_joint", "disagreement")


cte("s_inh", """
SELECT f.geo_level, f.geo_id, f.indicator_id, f.value, f.percentile FROM s_feats f JOIN s_univ u ON u.geo_id = f.geo_id WHERE f.geo_level = 'place'
UNION ALL SELECT 'place', u.geo_id, f.indicator_id, f.value, f.percentile FROM s_univ u JOIN s_feats f ON f.geo_id = u.county_geoid AND f.geo_level = 'county'
WHERE u.geo_level = 'place'""")


def towns(spark, sf):
    return base.universe(spark, sf).where("geo_level = 'place'").select("geo_id", "county_geoid")


@query("d14_inherit_parent", "SELECT geo_level, geo_id, indicator_id, round(value, 6) AS value, round(percentile, 6) AS percentile FROM s_inh")
def d14(spark, sf):
    out = sc.inherit_parent(base.features(spark, sf), towns(spark, sf))
    return r6(out.select("geo_level", "geo_id", "indicator_id", "value", "percentile"), "value", "percentile")


@query("d14_weighted_inherit", """
SELECT geo_level, geo_id, indicator_id, round(value, 6) AS value, round(percentile, 6) AS percentile FROM (
  SELECT geo_level, geo_id, indicator_id, value, percentile FROM s_feats WHERE geo_level = 'place'
  UNION ALL SELECT 'place', geo_id, indicator_id, sum(value * w) / sum(w),
    sum(percentile * w) FILTER (percentile IS NOT NULL) / sum(w) FILTER (percentile IS NOT NULL)
  FROM (SELECT u.geo_id, u.county_geoid AS c, 0.75 AS w FROM s_univ u WHERE geo_level = 'place' UNION ALL
    SELECT u.geo_id, lpad(CAST((CAST(u.county_geoid AS INT) + 1) % 25 AS VARCHAR), 5, '0'), 0.25 FROM s_univ u WHERE geo_level = 'place') l
  JOIN (SELECT geo_id AS c, indicator_id, value, percentile FROM s_feats WHERE geo_level = 'county' AND value IS NOT NULL) USING (c) GROUP BY 1, 2, 3)""")
def d14_weighted(spark, sf):
    t = towns(spark, sf).withColumnRenamed("geo_id", "place_geoid")
    nxt = F.lpad(((F.col("county_geoid").cast("int") + 1) % 25).cast("string"), 5, "0")
    links = t.withColumn("weight", F.lit(0.75)).unionByName(t.withColumn("county_geoid", nxt).withColumn("weight", F.lit(0.25)))
    return r6(sc.weighted_inherit(base.features(spark, sf), links), "value", "percentile")


cte("s_winners", """
SELECT profile_id, geo_id AS county_geoid FROM sc_score WHERE geo_id IN (SELECT county_geoid FROM s_univ WHERE geo_level = 'place')
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, geo_id) <= 8""")
cte("s_fdesir", f"""
SELECT * FROM (SELECT v.profile_id, v.domain, f.geo_id, f.indicator_id, v.iw, {base.sql_desirability('v.curve', 'f.value', 'f.percentile', 'v.')} AS d
  FROM s_inh f JOIN s_view v USING (indicator_id) JOIN s_univ u ON u.geo_id = f.geo_id
  JOIN s_winners w ON w.profile_id = v.profile_id AND w.county_geoid = u.county_geoid) WHERE d IS NOT NULL""")
base.scoring_ctes("s2", "s_fdesir")


@query("d15_two_stage", f"SELECT {SCORE_COLS} FROM s2_score")
def d15(spark, sf):
    _, places = sc.two_stage(base.features(spark, sf), base.universe(spark, sf), base.registry(spark), base.profiles(spark), top=8)
    return rounded(places)


@query("d15_winning_counties", "SELECT profile_id, county_geoid AS geo_id FROM s_winners")
def d15_winners(spark, sf):
    return sc.winning_counties(scored_counties(spark, sf), base.universe(spark, sf), 8)


# Drawn weights as one integer formula in both dialects.
cte("s_draws", """
SELECT profile_id, domain, CAST(d AS INTEGER) AS draw, weight * (0.5 + ((d * 37 + length(domain) * 11 + ascii(domain) * 5) % 101) / 100.0::DOUBLE) AS weight
FROM s_dw, range(0, 40) t(d) WHERE weight > 0""")
cte("s_bdraw", """
SELECT w.profile_id, w.draw, d.geo_id, sum(w.weight * CASE WHEN k IS NULL OR k = 1 THEN ln(greatest(d, 0.01)) ELSE centre + k * (ln(greatest(d, 0.01)) - centre) END)
  / sum(w.weight) AS lg, sum(w.weight) AS w FROM sp_dom d JOIN s_draws w USING (profile_id, domain) LEFT JOIN sp_infl i USING (profile_id, domain) GROUP BY 1, 2, 3""")
# Percentiles of ranks in hundredths of a rank, all of them whole numbers.
cte("s_branks", """
SELECT profile_id, geo_id, list(r ORDER BY r) AS rs, count(*) - 1 AS m
FROM (SELECT b.*, row_number() OVER (PARTITION BY profile_id, draw ORDER BY round(lg, 12) DESC, geo_id) AS r FROM s_bdraw b
  JOIN (SELECT profile_id, draw, sum(weight) AS t FROM s_draws GROUP BY 1, 2) USING (profile_id, draw) WHERE w / t >= 0.8) GROUP BY 1, 2""")
HUNDREDTHS = lambda p: f"(rs[m * {p} // 100 + 1] * 100 + (m * {p} % 100) * (rs[least(m * {p} // 100 + 2, m + 1)] - rs[m * {p} // 100 + 1]))"
cte("s_bands", f"""
SELECT profile_id, geo_id, CAST({HUNDREDTHS(50)} // 100 AS BIGINT) AS rank_median, CAST({HUNDREDTHS(5)} // 100 AS BIGINT) AS rank_p05,
  CAST({HUNDREDTHS(95)} // 100 AS BIGINT) AS rank_p95, CAST(({HUNDREDTHS(95)} - {HUNDREDTHS(5)}) // 100 AS BIGINT) AS rank_spread FROM s_branks""")


def formula_draws(spark, n=40):
    w = base.profiles(spark).domain_weights.where("weight > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = (F.col("draw") * 37 + F.length("domain") * 11 + F.ascii("domain") * 5) % 101
    return w.withColumn("weight", F.col("weight") * (0.5 + step / 100.0))


@query("d16_rank_bands", "SELECT * FROM s_bands")
def d16(spark, sf):
    return sc.rank_bands(base.place_features(spark, sf), base.registry(spark), base.profiles(spark), formula_draws(spark))


@query("d16_rank_bands_dirichlet")
def d16_dirichlet(spark, sf):
    """All places x 200 draws from the Dirichlet sampler, per profile."""
    p = base.profiles(spark)
    return sc.rank_bands(base.place_features(spark, sf), base.registry(spark), p, sc.dirichlet_draws(p))


@query("d17_ranking", """
SELECT profile_id, geo_id, round(score, 6) AS score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, geo_id) AS rank FROM sp_score""")
def d17(spark, sf):
    return r6(sc.ranking(scored_places(spark, sf)).select("profile_id", "geo_id", "score", "rank"), "score")


@query("d18_score_all_profiles", """
SELECT c.profile_id, c.geo_id, round(c.score, 6) AS score, 'county' AS geo_level FROM sc_score c UNION ALL
SELECT profile_id, geo_id, round(score, 6), 'place' FROM sp_score""")
def d18(spark, sf):
    c = scored_counties(spark, sf).withColumn("geo_level", F.lit("county"))
    p = scored_places(spark, sf).withColumn("geo_level", F.lit("place"))
    return r6(c.unionByName(p).select("profile_id", "geo_id", "score", "geo_level"), "score")


@query("d19_default_profile", """
SELECT 'placeholder' AS profile_id, geo_id, round(exp(sum(default_weight * ln(greatest(d, 0.01))) / sum(default_weight)), 6) AS plain_score
FROM (SELECT geo_id, domain, exp(sum(ln(greatest(d, 0.01))) / count(*)) AS d FROM (
  SELECT f.geo_id, r.domain, """ + base.sql_desirability("r.curve", "f.value", "f.percentile", "r.") + """ AS d FROM s_feats f JOIN s_reg r USING (indicator_id)
  WHERE r.scoring AND NOT r.sensitive AND f.geo_level = 'county') WHERE d IS NOT NULL GROUP BY 1, 2) JOIN s_domains USING (domain) WHERE default_weight > 0 GROUP BY 2""")
def d19(spark, sf):
    w = regs.default_profile(base.domains(spark)).drop("method")
    empty = base.profiles(spark)
    none = lambda df: df.where("profile_id = 'placeholder'")
    p = regs.Profiles(w, none(empty.indicator_weights), none(empty.overrides), none(empty.opt_ins), none(empty.knockouts))
    d = sc.domain_scores(base.county_features(spark, sf), base.registry(spark), p)
    plain = d.groupBy("profile_id", "geo_id").agg(sc.geometric_mean(F.col("d"), F.col("weight")).alias("plain_score"))
    return r6(plain, "plain_score")
