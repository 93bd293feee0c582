"""Elicitation operators over the driver's tables.

Brands are the places compared: a task sets one brand against the next on five averages over
all line items. Respondents are the users of `events`; a user's last event on a question is the
answer, and event counts are the stated budget.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.functions import stats as fstats
from geofit.operators import elicit as el
from geofit.operators import features as feat
from geofit.operators import scoring as sc
from geofit.operators import validate as val
from geofit.operators.lineage import cut
from geofit.operators.registry import Profiles, explode_profiles, local_frame, registry_frame
from geofit.plans import demo_base as base
from geofit.plans import demo_sources as src
from geofit.plans.catalog import cte, query, r6, table

ATTRS = [
    ("avg_price", "cost", "lower_better", None), ("avg_disc", "cost", "ideal_band", dict(lo=0.0495, hi=0.0505, shoulder=0.001)), ("avg_qty", "quality", "higher_better", None),
    ("avg_size", "quality", "ideal_point", dict(target=25.5, tol=1.0)), ("avg_tax", "tax", "lower_better", None),
]
ENTRIES = [base.ind(i, d, "place", "index", c, p) for i, d, c, p in ATTRS] + [base.ind("secret", "sensitive", "place", "index", "higher_better", sensitive=True)]


def registry(spark):
    return registry_frame(spark, ENTRIES)


def brand_features(spark, sf):
    """Five averages per brand with their percentile, long."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, cents = F.count(F.lit(1)), lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    per = j.groupBy("p_brand").agg((cents("l_extendedprice") / n / 100).alias("avg_price"), (cents("l_discount") / n / 100).alias("avg_disc"), (cents("l_quantity") / n / 100).alias("avg_qty"),
                                   (F.sum("p_size") / n).alias("avg_size"), (cents("l_tax") / n / 100).alias("avg_tax"))
    long = per.select(F.col("p_brand").alias("geo_id"), F.lit("place").alias("geo_level"), F.inline(F.array(*[F.struct(F.lit(a).alias("indicator_id"), F.col(a).alias("value")) for a, *_ in ATTRS])))
    return cut(feat.add_percentile(long, "value"))


def tasks(spark, sf):
    """t_i: the i-th brand against the next one; r_0..r_3 ask t_0..t_3 again."""
    f = brand_features(spark, sf)
    no = F.regexp_extract("geo_id", r"(\d+)", 1).cast("int") - 1
    left = f.select(no.alias("i"), "indicator_id", F.col("value").alias("a_raw"), F.col("percentile").alias("a_pct"))
    right = f.select(((no + 24) % 25).alias("i"), "indicator_id", F.col("value").alias("b_raw"), F.col("percentile").alias("b_pct"))
    t = left.join(right, ["i", "indicator_id"]).groupBy("i").agg(F.array_sort(F.collect_list(
        F.struct(F.col("indicator_id").alias("indicator"), "a_raw", "b_raw", "a_pct", "b_pct"))).alias("attributes"))
    t = t.select(F.concat(F.lit("t_"), src.text("i")).alias("task_id"), F.lit(None).cast("string").alias("repeat_of"), "attributes", "i")
    again = t.where("i < 4").withColumn("repeat_of", F.col("task_id")).withColumn("task_id", F.concat(F.lit("r_"), src.text("i")))
    return cut(t.unionByName(again).drop("i"))


def answers(spark, sf):
    q = F.col("event_id") % 29
    question = F.when(q < 25, F.concat(F.lit("t_"), src.text(q))).otherwise(F.concat(F.lit("r_"), src.text(q - 25)))
    last = table(spark, sf, "events").groupBy(src.text("user_id").alias("person"), question.alias("question_id")).agg(F.max_by("event_type", "event_id").alias("t"))
    return last.select("person", "question_id", F.when(F.col("t").isin("view", "click"), "A").when(F.col("t").isin("purchase", "signup"), "B").otherwise("skip").alias("value"))


BUDGET = [("cost", "view"), ("quality", "click"), ("tax", "purchase"), ("sensitive", "signup"), ("schools", "error")]


def stated(spark, sf):
    counts = table(spark, sf, "events").groupBy(src.text("user_id").alias("person"), F.col("event_type")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counts.join(local_frame(spark, BUDGET, "domain string, event_type string"), "event_type").select("person", "domain", "weight")


base.values("e_reg", "indicator_id, domain, curve, lo, hi, shoulder, shoulder_lo, shoulder_hi, target, tol", [(i, d, c, *base.plist(p)) for i, d, c, p in ATTRS])
cte("e_attr", """
SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) - 1 AS i, unnest([{'n': 'avg_price', 'v': sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100},
  {'n': 'avg_disc', 'v': sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100}, {'n': 'avg_qty', 'v': sum(CAST(round(l_quantity * 100) AS BIGINT)) / count(*) / 100},
  {'n': 'avg_size', 'v': sum(p_size) / count(*)}, {'n': 'avg_tax', 'v': sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 100}]) AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
cte("e_val", """
SELECT i, x.n AS ind, x.v AS v, (rank() OVER (PARTITION BY x.n ORDER BY x.v) + (count(*) OVER (PARTITION BY x.n, x.v) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY x.n) - 1) AS pct FROM e_attr""")
cte("e_task", "SELECT a.i, a.ind, a.v AS a_raw, b.v AS b_raw, a.pct AS a_pct, b.pct AS b_pct FROM e_val a JOIN e_val b ON b.ind = a.ind AND b.i = (a.i + 1) % 25")
cte("e_ans", """
SELECT CAST(user_id AS VARCHAR) AS person, event_id % 29 AS q, CASE WHEN arg_max(event_type, event_id) IN ('view', 'click') THEN 'A' WHEN arg_max(event_type, event_id) IN ('purchase', 'signup') THEN 'B' ELSE 'skip' END AS value FROM events GROUP BY 1, 2""")
cte("e_stated", "SELECT CAST(user_id AS VARCHAR) AS person, CASE event_type WHEN 'view' THEN 'cost' WHEN 'click' THEN 'quality' WHEN 'purchase' THEN 'tax' WHEN 'signup' THEN 'sensitive' ELSE 'schools' END AS domain, count(*)::DOUBLE AS weight FROM events GROUP BY 1, 2")
cte("e_budget", "SELECT person, domain, round(weight / sum(weight) OVER (PARTITION BY person) * 100, 2) AS weight FROM e_stated")

# ------------------------------------------------------------------------- E1-E6

POOL = ["spend_total", "spend_per_order", "order_count", "balance", "big_order", "urgent_share", "retired_count", "open_share"]
POOL_SQL = "('" + "', '".join(POOL) + "')"
cte("e_pool", f"""
SELECT f.geo_id FROM s_feats f JOIN s_univ u ON u.geo_id = f.geo_id AND u.population > 6 WHERE indicator_id IN {POOL_SQL} AND value IS NOT NULL
GROUP BY 1 HAVING count(*) = {len(POOL)}""")
cte("e_turn", "SELECT geo_id, r, md5('7|' || r || '|' || geo_id) AS h FROM e_pool, range(1, 9) t(r)")
cte("e_pair", """
SELECT DISTINCT a, b FROM (SELECT geo_id AS a, coalesce(lead(geo_id) OVER w, first_value(geo_id) OVER w) AS b, row_number() OVER w AS n FROM e_turn WINDOW w AS (PARTITION BY r ORDER BY h, geo_id)) WHERE n % 2 = 1 AND a <> b""")
cte("e_both", """
SELECT p.a, p.b, x.indicator_id AS ind, x.value AS a_raw, y.value AS b_raw, x.percentile AS a_pct, y.percentile AS b_pct, r.curve = 'lower_better' AS low, md5('7|' || p.a || '|' || p.b || '|' || x.indicator_id) AS h
FROM e_pair p JOIN s_feats x ON x.geo_id = p.a JOIN s_feats y ON y.geo_id = p.b AND y.indicator_id = x.indicator_id JOIN s_reg r ON r.indicator_id = x.indicator_id
WHERE x.indicator_id IN """ + POOL_SQL + """ AND abs(x.percentile - y.percentile) >= 0.25
  AND (x.indicator_id <> 'big_order' OR abs(least(4, greatest(0, floor(x.percentile * 5))) - least(4, greatest(0, floor(y.percentile * 5)))) >= 2)""")
cte("e_cand", """
SELECT a, b, list(ind ORDER BY h) AS inds FROM (SELECT * FROM e_both QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY h) <= 5) GROUP BY 1, 2
HAVING count(*) = 5 AND NOT bool_and(CASE WHEN low THEN a_raw <= b_raw ELSE a_raw >= b_raw END) AND NOT bool_and(CASE WHEN low THEN b_raw <= a_raw ELSE b_raw >= a_raw END)""")
cte("e_choice", "SELECT a, b, 'choice_' || row_number() OVER (ORDER BY md5('7|' || a || '|' || b)) AS task_id, inds FROM e_cand QUALIFY row_number() OVER (ORDER BY md5('7|' || a || '|' || b)) <= 25")


def candidates(spark, sf):
    return el.choice_candidates(base.place_features(spark, sf), base.universe(spark, sf), base.registry(spark), POOL, min_population=6)


shown = lambda: F.array_join(F.transform("attributes", lambda x: x["indicator"]), ",")


@query("e1_choice_pairs", "SELECT task_id, a, b, array_to_string(inds, ',') AS shown FROM e_choice")
def e1(spark, sf):
    return el.choice_pairs(candidates(spark, sf)).select("task_id", "a", "b", shown().alias("shown"))


@query("e2_dominance_test", "SELECT a, b, array_to_string(inds, ',') AS shown FROM e_cand")
def e2(spark, sf):
    return candidates(spark, sf).select("a", "b", shown().alias("shown"))


@query("e3_describe", """
SELECT geo_id, CAST(least(4, greatest(0, floor(percentile * 5))) AS INT) AS rung, CASE WHEN percentile IS NULL THEN '—' ELSE ['very low', 'low', 'middling', 'high', 'very high'][CAST(least(4, greatest(0, floor(percentile * 5))) AS INT) + 1] END AS words
FROM s_feats WHERE indicator_id = 'big_order'""")
def e3(spark, sf):
    f = base.place_features(spark, sf).join(base.registry(spark).where("phrases is not null").select("indicator_id", "unit", "phrases", "phrasing"), "indicator_id")
    return f.select("geo_id", el.phrase_rung(F.col("percentile"), F.col("phrases")).alias("rung"), el.describe(F.col("value"), F.col("percentile"), F.col("unit"), F.col("phrases"), F.col("phrasing")).alias("words"))


@query("e4_repeat_tasks", """
SELECT task_id, NULL::VARCHAR AS repeat_of, a, b FROM e_choice UNION ALL
SELECT task_id || '_repeat', task_id, a, b FROM e_choice QUALIFY row_number() OVER (ORDER BY md5('7|repeat|' || task_id)) <= 4""")
def e4(spark, sf):
    return el.repeat_tasks(cut(el.choice_pairs(candidates(spark, sf))), 4).select("task_id", "repeat_of", "a", "b")


cte("e_anchor", "SELECT indicator_id, arg_max(value, geo_id) AS anchor_value FROM s_feats WHERE geo_id IN ('000000001', '00001') AND value IS NOT NULL GROUP BY 1")
HOME = ["000000001", "00001"]


@query("e5_baseline_values", """
SELECT 'band_' || r.indicator_id AS question_id, round(anchor_value, 6) AS anchor_value FROM s_reg r LEFT JOIN e_anchor USING (indicator_id)""")
def e5(spark, sf):
    reg = base.registry(spark)
    return r6(el.anchored_items(reg, el.baseline_values(base.features(spark, sf), HOME), reg).select("question_id", "anchor_value"), "anchor_value")


cte("e_known", """
(SELECT * FROM s_univ WHERE geo_level = 'place' ORDER BY population DESC NULLS LAST, geo_id LIMIT 18) UNION
(SELECT * FROM s_univ WHERE geo_level = 'place' AND state_usps IN ('R1', 'R3') AND population > 9 ORDER BY population DESC NULLS LAST, geo_id LIMIT 12) UNION SELECT * FROM s_univ WHERE geo_id = '000000001'""")


@query("e6_calibration_pool", "SELECT geo_id, name, population FROM e_known ORDER BY md5('11|' || geo_id) LIMIT 20")
def e6(spark, sf):
    places = base.universe(spark, sf).where("geo_level = 'place'")
    return el.calibration_pool(places, HOME, ["R1", "R3"], 9, 20).select("geo_id", "name", "population")


# ------------------------------------------------------------------------- E7-E17


@query("e7_choice_matrix", """
SELECT person, 't_' || q AS task_id, value = 'A' AS chose_a, ind AS indicator_id, round(CASE WHEN curve = 'lower_better' THEN b_raw - a_raw ELSE a_raw - b_raw END, 6) AS diff
FROM e_ans JOIN e_task ON i = q JOIN e_reg ON indicator_id = ind WHERE value <> 'skip'""")
def e7(spark, sf):
    return r6(el.choice_matrix(tasks(spark, sf), answers(spark, sf), registry(spark)), "diff")


@query("e8_contradictions", "SELECT r.person, 't_' || (r.q - 25) AS task_id FROM e_ans r JOIN e_ans t ON t.person = r.person AND t.q = r.q - 25 WHERE r.q >= 25 AND r.value <> 'skip' AND t.value <> 'skip' AND r.value <> t.value")
def e8(spark, sf):
    return el.contradictions(tasks(spark, sf), answers(spark, sf))


def fits(spark, sf):
    return cut(el.fit_choices(el.choice_matrix(tasks(spark, sf), answers(spark, sf), registry(spark))))


@query("e9_fit_choices")
def e9(spark, sf):
    return fits(spark, sf).select("person", "n_choices", F.explode("coefficients").alias("indicator_id", "coefficient"))


@query("e9_fit_optimality", """
SELECT person, ind AS indicator_id, CAST(count(*) AS INT) AS n_choices, 0.0::DOUBLE AS gradient
FROM e_ans JOIN e_task ON i = q WHERE value <> 'skip' GROUP BY 1, 2 HAVING count(*) >= 4""")
def e9_optimality(spark, sf):
    """Where the fitted coefficients leave the likelihood's slope: nowhere but at its one optimum is it zero."""
    m = cut(el.choice_matrix(tasks(spark, sf), answers(spark, sf), registry(spark)))
    return r6(el.fit_gradient(m, cut(el.fit_choices(m))), "gradient")


@query("e10_loo_accuracy")
def e10(spark, sf):
    return fits(spark, sf).select("person", "n_choices", "accuracy", "cv_accuracy")


cte("e_sig", """
SELECT person, CAST(count(*) FILTER (value <> 'skip') AS INT) AS n_choices, count(*) FILTER (value = 'A') / count(*) AS accuracy, CASE WHEN count(*) FILTER (value = 'B') % 3 <> 0 THEN count(*) FILTER (value = 'B') / count(*) * 1.6 END AS cv_accuracy
FROM e_ans WHERE q < 25 GROUP BY 1""")


def signals(spark, sf):
    a, b = (F.count_if(F.col("value") == v) for v in ("A", "B"))
    n = F.count(F.lit(1))
    return answers(spark, sf).where("startswith(question_id, 't_')").groupBy("person").agg((a + b).cast("int").alias("n_choices"), (a / n).alias("accuracy"), F.when(b % 3 != 0, b / n * 1.6).alias("cv_accuracy"))


@query("e11_is_informative", "SELECT person, n_choices >= 8 AND CASE WHEN cv_accuracy IS NULL THEN accuracy >= 0.65 ELSE cv_accuracy >= 0.68 END AS informative FROM e_sig")
def e11(spark, sf):
    return signals(spark, sf).select("person", el.is_informative().alias("informative"))


# Weights per person and attribute with an SQL twin: the share of A answers on tasks where the attribute separates.
cte("e_w", "SELECT person, ind AS indicator_id, sum(abs(a_pct - b_pct)) FILTER (value = 'A') / sum(abs(a_pct - b_pct)) AS w FROM e_ans JOIN e_task ON i = q WHERE value <> 'skip' GROUP BY 1, 2")
cte("e_rev", """
SELECT person, domain, round(m / t * 100, 2) AS weight FROM (SELECT *, sum(m) OVER (PARTITION BY person) AS t FROM (
  SELECT person, domain, avg(coalesce(w, 0)) AS m FROM e_w JOIN e_reg USING (indicator_id) GROUP BY 1, 2)) WHERE t > 0""")


def revealed(spark, sf):
    m = el.choices(tasks(spark, sf), answers(spark, sf)).where("repeat_of is null").select("person", "value", F.inline("attributes"))
    gap = F.abs(F.col("a_pct") - F.col("b_pct"))
    w = m.groupBy("person", "indicator").agg((F.coalesce(F.sum(F.when(F.col("value") == "A", gap)), F.lit(0.0)) / F.sum(gap)).alias("w"))
    packed = w.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("indicator", "w"))).alias("weights"))
    return el.domain_weights_from_choices(packed, registry(spark))


@query("e12_domain_weights_from_choices", "SELECT * FROM e_rev")
def e12(spark, sf):
    return revealed(spark, sf)


cte("e_mix", """
SELECT coalesce(s.person, r.person) AS person, coalesce(s.domain, r.domain) AS domain, CASE WHEN r.weight IS NOT NULL THEN 0.65 * r.weight + 0.35 * coalesce(s.weight, 0) ELSE s.weight END AS weight
FROM e_budget s FULL JOIN e_rev r ON r.person = s.person AND r.domain = s.domain""")
cte("e_blend", "SELECT person, domain, round(weight / sum(weight) OVER (PARTITION BY person) * 100, 2) AS weight FROM e_mix")


def budget(spark, sf):
    return el.normalise_budget(stated(spark, sf))


@query("e13_blend_weights", "SELECT * FROM e_blend")
def e13(spark, sf):
    return el.blend_weights(budget(spark, sf), revealed(spark, sf))


@query("e13_uncovered_domains", """
SELECT person, domain, 'stated only' AS note FROM e_budget b WHERE domain <> 'schools' AND NOT EXISTS (SELECT 1 FROM e_rev r WHERE r.person = b.person AND r.domain = b.domain)
UNION ALL SELECT person, domain, 'no data' FROM e_budget WHERE domain = 'schools'""")
def e13_notes(spark, sf):
    return el.uncovered_domains(budget(spark, sf), revealed(spark, sf), local_frame(spark, [("schools",)], "domain string"))


@query("e14_normalise_budget", "SELECT * FROM e_budget")
def e14(spark, sf):
    return budget(spark, sf)


@query("e15_stated_vs_revealed", """
SELECT person, domain, s AS stated, r AS revealed, CASE WHEN r > s THEN 'more' ELSE 'less' END AS direction FROM (
  SELECT coalesce(s.person, r.person) AS person, coalesce(s.domain, r.domain) AS domain, coalesce(s.weight, 0) AS s, coalesce(r.weight, 0) AS r FROM e_budget s FULL JOIN e_rev r ON r.person = s.person AND r.domain = s.domain) WHERE abs(s - r) >= 10""")
def e15(spark, sf):
    return el.stated_vs_revealed(budget(spark, sf), revealed(spark, sf))


cte("e_ov", "SELECT CAST(user_id AS VARCHAR) AS person, 'avg_tax' AS indicator_id, user_id % 2 = 0 AS indifferent FROM events GROUP BY user_id HAVING user_id % 3 = 0")
cte("e_gap", f"""
SELECT a.person, a.q, a.value, r.domain, {base.sql_desirability("CASE WHEN o.person IS NOT NULL THEN 'higher_better' ELSE r.curve END", 't.a_raw', 't.a_pct', 'r.')} - ({base.sql_desirability("CASE WHEN o.person IS NOT NULL THEN 'higher_better' ELSE r.curve END", 't.b_raw', 't.b_pct', 'r.')}) AS gap
FROM e_ans a JOIN e_task t ON t.i = a.q JOIN e_reg r ON r.indicator_id = t.ind LEFT JOIN e_ov o ON o.person = a.person AND o.indicator_id = t.ind WHERE a.value <> 'skip' AND NOT coalesce(o.indifferent, false)""")
cte("e_margin", """
SELECT person, 't_' || q AS task_id, any_value(value) AS value, sum(weight * g) AS margin FROM (SELECT person, q, value, domain, avg(gap) AS g FROM e_gap GROUP BY 1, 2, 3, 4) JOIN e_budget USING (person, domain) GROUP BY 1, 2 HAVING abs(margin) > 1e-9""")


def overrides(spark, sf):
    u = F.col("user_id")
    rows = table(spark, sf, "events").select("user_id").distinct().where(u % 3 == 0)
    return rows.select(src.text(u).alias("person"), F.lit("avg_tax").alias("indicator_id"), (u % 2 == 0).alias("indifferent"), F.when(u % 2 == 1, "higher_better").alias("curve"), F.lit(None).cast(val_params()).alias("params"))


def val_params():
    from geofit.functions.curves import PARAMS_TYPE
    return PARAMS_TYPE


def margins(spark, sf):
    return el.task_margins(tasks(spark, sf), answers(spark, sf), budget(spark, sf), registry(spark), overrides(spark, sf))


cte("e_agree", "SELECT person, count(*) AS n_choices, count(*) FILTER ((margin > 0) = (value = 'A')) AS correct FROM e_margin GROUP BY 1")
TAIL = "least(1, (SELECT sum(exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2))) FROM range({s}, {n} + 1) t(k)))"


@query("e16_agreement", "SELECT person, n_choices, correct, round(correct / n_choices, 6) AS rate, round(" + TAIL.format(n="n_choices", s="correct") + ", 6) AS p_value FROM e_agree")
def e16(spark, sf):
    return r6(el.agreement(margins(spark, sf)).drop("significant"), "rate", "p_value")


@query("e16_agreement_misses", """
SELECT person, CAST(row_number() OVER (PARTITION BY person ORDER BY round(abs(margin), 9) DESC, task_id) AS INT) AS n, task_id, round(margin, 6) AS margin FROM e_margin WHERE (margin > 0) <> (value = 'A') QUALIFY n <= 5""")
def e16_misses(spark, sf):
    return r6(el.agreement_misses(margins(spark, sf)), "margin")


cte("e_bin", "SELECT CAST(user_id AS VARCHAR) AS person, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS s, count(*) AS n FROM events GROUP BY 1")


@query("e17_binomial_tail", "SELECT person, s, n, round(" + TAIL.format(n="n", s="s") + ", 6) AS p FROM e_bin")
def e17(spark, sf):
    g = table(spark, sf, "events").groupBy(src.text("user_id").alias("person")).agg(F.count_if(F.col("event_type").isin("view", "click", "signup")).alias("s"), F.count(F.lit(1)).alias("n"))
    return r6(g.withColumn("p", fstats.binomial_tail(F.col("s"), F.col("n"))), "p")


# ------------------------------------------------------------------------- E18-E26

BAND_COLS = "person, indicator_id, indifferent, lo, hi, shoulder"
cte("e_off", "SELECT CAST(user_id AS VARCHAR) AS person, CASE event_id % 3 WHEN 0 THEN 'spend_total' WHEN 1 THEN 'balance' ELSE 'suppliers' END AS indicator_id, CASE arg_max(event_type, event_id) WHEN 'view' THEN -2.0 WHEN 'click' THEN -1.0 WHEN 'purchase' THEN 0.0 WHEN 'signup' THEN 1.5 END AS off FROM events GROUP BY 1, 2")
cte("e_band", """
SELECT person, indicator_id, off IS NULL AS indifferent, CASE WHEN off IS NOT NULL THEN greatest(anchor_value + off * u * 0.6 - u * 0.5, floor) END AS lo, CASE WHEN off IS NOT NULL THEN anchor_value + off * u * 0.6 + u * 0.5 END AS hi, CASE WHEN off IS NOT NULL THEN u END AS shoulder
FROM (SELECT *, CASE WHEN std <> 0 THEN std ELSE abs(mean) * 0.1 END AS u FROM e_off JOIN s_stats USING (indicator_id) LEFT JOIN e_anchor USING (indicator_id)) WHERE off IS NULL OR anchor_value IS NOT NULL""")


def offsets(spark, sf):
    m = F.col("event_id") % 3
    ind = F.when(m == 0, "spend_total").when(m == 1, "balance").otherwise("suppliers")
    t = F.col("t")
    last = table(spark, sf, "events").groupBy(src.text("user_id").alias("person"), ind.alias("indicator_id")).agg(F.max_by("event_type", "event_id").alias("t"))
    return last.select("person", "indicator_id", F.when(t == "view", -2.0).when(t == "click", -1.0).when(t == "purchase", 0.0).when(t == "signup", 1.5).alias("offset"))


def offset_bands(spark, sf):
    f = base.features(spark, sf)
    return el.band_from_offset(offsets(spark, sf), el.baseline_values(f, HOME), feat.indicator_stats(f))


@query("e18_band_from_offset", f"SELECT person, indicator_id, indifferent, round(lo, 2) AS lo, round(hi, 2) AS hi, round(shoulder, 2) AS shoulder FROM e_band")
def e18(spark, sf):
    out = offset_bands(spark, sf).select("person", "indicator_id", "indifferent", "params.lo", "params.hi", "params.shoulder")
    return r6(out, "lo", "hi", "shoulder", places=2)


SIZES = [("q_size", "view", 5000.0, None, "order_count"), ("q_size", "click", 60000.0, 2.0, "order_count"), ("q_size", "purchase", None, None, "order_count"), ("q_price", "signup", 1234.0, 3.0, "balance")]
base.values("e_sz", "question_id, value, centre, spread, indicator_id", SIZES)
cte("e_last", "SELECT CAST(user_id AS VARCHAR) AS person, CASE event_id % 2 WHEN 0 THEN 'q_size' ELSE 'q_price' END AS question_id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1, 2")


def last_answers(spark, sf):
    q = F.when(F.col("event_id") % 2 == 0, "q_size").otherwise("q_price")
    return table(spark, sf, "events").groupBy(src.text("user_id").alias("person"), q.alias("question_id")).agg(F.max_by("event_type", "event_id").alias("value"))


@query("e19_band_from_option", """
SELECT person, indicator_id, centre IS NULL AS indifferent, round(centre / coalesce(spread, 2.5), 2) AS lo, round(centre * coalesce(spread, 2.5), 2) AS hi, round(centre * coalesce(spread, 2.5) - centre / coalesce(spread, 2.5), 2) AS shoulder,
  round(centre / coalesce(spread, 2.5) * 0.75, 2) AS shoulder_lo FROM e_last JOIN e_sz USING (question_id, value)""")
def e19(spark, sf):
    opts = local_frame(spark, SIZES, "question_id string, value string, centre double, spread double, indicator_id string")
    out = el.band_from_option(last_answers(spark, sf), opts)
    return out.select("person", "indicator_id", "indifferent", *[F.round(f"params.{c}", 2).alias(c) for c in ("lo", "hi", "shoulder", "shoulder_lo")])


LIMITS = [("q_size", v, t, "order_count", "min") for v, t in (("view", 5.0), ("click", 8.0), ("purchase", None), ("signup", 2.0), ("error", None))] + [("q_price", v, t, "balance", None) for v, t in (("view", 900.0), ("click", None), ("purchase", 5000.0), ("signup", 7000.0), ("error", 100.0))]
base.values("e_lim", "question_id, value, threshold, indicator_id, op", LIMITS)


def limits(spark, sf):
    return el.knockouts_from_answers(last_answers(spark, sf), local_frame(spark, LIMITS, "question_id string, value string, threshold double, indicator_id string, op string"))


@query("e20_knockouts_from_answers", "SELECT person, question_id, indicator_id, coalesce(op, 'max') AS op, threshold FROM e_last JOIN e_lim USING (question_id, value) WHERE threshold IS NOT NULL")
def e20(spark, sf):
    return limits(spark, sf)


cte("e_opt", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS person, 'Politics' AS label, 'secret' AS indicator_id FROM events WHERE user_id % 4 = 1")


def opted(spark, sf):
    u = F.col("user_id")
    labels = table(spark, sf, "events").select("user_id").distinct().select(src.text(u).alias("person"), F.when(u % 4 == 1, F.array(F.lit("Politics"), F.lit("None of these"))).otherwise(F.array(F.lit("None of these"))).alias("chosen"))
    return el.sensitive_opt_in(labels, local_frame(spark, [("Politics", "secret"), ("None of these", None)], "label string, indicator_id string"))


@query("e21_sensitive_opt_in", "SELECT * FROM e_opt")
def e21(spark, sf):
    return opted(spark, sf)


cte("e_forf", """
SELECT person, domain, CASE WHEN lose THEN round(CASE WHEN domain = 'sensitive' THEN 0 ELSE weight END / sum(CASE WHEN domain = 'sensitive' THEN 0 ELSE weight END) OVER (PARTITION BY person) * 100, 2) ELSE weight END AS weight
FROM (SELECT *, person NOT IN (SELECT person FROM e_opt) AND bool_or(domain = 'sensitive' AND weight > 0) OVER (PARTITION BY person) AS lose FROM e_budget)""")


@query("e21_forfeit_sensitive", "SELECT * FROM e_forf")
def e21_forfeit(spark, sf):
    return el.forfeit_sensitive(budget(spark, sf), opted(spark, sf))


@query("e22_domains_without_data", "SELECT DISTINCT domain FROM s_reg WHERE domain NOT IN (SELECT r.domain FROM s_reg r JOIN s_feats f USING (indicator_id) WHERE f.value IS NOT NULL AND f.geo_level = 'place')")
def e22(spark, sf):
    return el.domains_without_data(base.registry(spark), base.place_features(spark, sf))


LOCKS = [("cost", "Cost", 30.0, True, False, True), ("tax", "Tax", 5.0, True, False, False)]


@query("e23_locked_weights", """
SELECT person, domain, round(weight / sum(weight) OVER (PARTITION BY person) * 100, 2) AS weight FROM (SELECT person, domain, weight FROM e_budget WHERE domain <> 'cost' UNION ALL SELECT DISTINCT person, 'cost', 30.0 FROM e_budget)""")
def e23(spark, sf):
    return el.locked_weights(budget(spark, sf), local_frame(spark, LOCKS, "domain string, label string, default_weight double, scoring boolean, sensitive boolean, locked boolean"))


@query("e24_indicator_weights", """
SELECT person, indicator_id, weight FROM (SELECT person, n_choices >= 8 AND CASE WHEN cv_accuracy IS NULL THEN accuracy >= 0.65 ELSE cv_accuracy >= 0.68 END AS good FROM e_sig) JOIN (SELECT person, indicator_id, round(coalesce(w, 0), 5) AS weight FROM e_w) USING (person) WHERE good
UNION ALL SELECT person, indicator_id, 0.15 FROM e_band WHERE NOT indifferent AND person NOT IN (SELECT s.person FROM e_sig s JOIN e_w USING (person) WHERE n_choices >= 8 AND CASE WHEN cv_accuracy IS NULL THEN accuracy >= 0.65 ELSE cv_accuracy >= 0.68 END)""")
def e24(spark, sf):
    m = el.choices(tasks(spark, sf), answers(spark, sf)).where("repeat_of is null").select("person", "value", F.inline("attributes"))
    gap = F.abs(F.col("a_pct") - F.col("b_pct"))
    w = m.groupBy("person", "indicator").agg((F.coalesce(F.sum(F.when(F.col("value") == "A", gap)), F.lit(0.0)) / F.sum(gap)).alias("w"))
    packed = w.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("indicator", "w"))).alias("weights"))
    return el.indicator_weights(signals(spark, sf).join(packed, "person"), offset_bands(spark, sf))


def built(spark, sf):
    """Profiles of every respondent, from fitted choices to nested rows."""
    fit, bands, rules, opt = fits(spark, sf), cut(offset_bands(spark, sf)), limits(spark, sf), opted(spark, sf)
    w = cut(el.final_domain_weights(stated(spark, sf), fit, registry(spark), opt))
    check = el.agreement(el.task_margins(tasks(spark, sf), answers(spark, sf), w, registry(spark), bands))
    quality = fit.select("person", "n_choices", "accuracy", "cv_accuracy", el.is_informative().alias("informative")).join(check.select("person", "rate", "p_value"), "person", "left")
    return el.build_profile(w, el.indicator_weights(fit, bands), bands, rules, opt, quality)


@query("e25_build_profile")
def e25(spark, sf):
    return built(spark, sf)


@query("e25_rank_built_profiles")
def e25_ranked(spark, sf):
    """Every respondent's ranking of the brands under the profile built from their answers."""
    p = explode_profiles(cut(built(spark, sf)))
    return sc.ranking(sc.score(brand_features(spark, sf), registry(spark), p)).select("profile_id", "geo_id", "score", "rank")


@query("e26_validate_profiles", """
SELECT person AS profile_id, 'unknown domain' AS rule, domain AS key FROM e_budget WHERE domain NOT IN ('cost', 'quality', 'tax', 'sensitive')
UNION ALL SELECT person, 'override on unregistered indicator', indicator_id FROM e_band
UNION ALL SELECT person, 'knockout on unregistered indicator', indicator_id FROM e_last JOIN e_lim USING (question_id, value) WHERE threshold IS NOT NULL
UNION ALL SELECT person, 'weights do not sum to 100', printf('%.1f', sum(weight)) FROM e_stated GROUP BY 1 HAVING abs(sum(weight) - 100) > 1""")
def e26(spark, sf):
    to = lambda df: df.withColumnRenamed("person", "profile_id")
    d = local_frame(spark, [(x,) for x in ("cost", "quality", "tax", "sensitive")], "domain string")
    rules = to(limits(spark, sf)).select("profile_id", "indicator_id")
    w = to(stated(spark, sf))
    empty = w.select("profile_id", F.col("domain").alias("indicator_id"), "weight").limit(0)
    p = Profiles(w, empty, to(offset_bands(spark, sf)), empty, rules)
    return val.validate_profiles(p, registry(spark), d)
