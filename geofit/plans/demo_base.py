"""Shared demo frames: registry, universe, long facts, features and profiles.

Places are customers in good standing (balance not negative), counties are nations. Facts
are sums over orders and line items, with nulls where a source would have gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geofit.functions.curves import PARAM_FIELDS
from geofit.operators import features as feat
from geofit.operators.lineage import cut
from geofit.operators.registry import DOMAIN_SCHEMA, Profiles, local_frame, profiles_from_rows, registry_frame
from geofit.plans.catalog import cte, table
from geofit.sources.normalise import inverse_hhi


def ind(i, domain, level, unit, curve, params=None, transform="none", scoring=True, sensitive=False, **more):
    return dict(indicator_id=i, domain=domain, geo_level=level, unit=unit, curve=curve, curve_params=params,
                transform=transform, scoring=scoring, sensitive=sensitive, source="orders", **more)


PHRASES = ["very low", "low", "middling", "high", "very high"]
REGISTRY = [
    ind("spend_total", "market", "place", "usd", "higher_better", transform="log"),
    ind("spend_per_order", "market", "place", "usd", "higher_better", transform="per_capita"),
    ind("order_count", "market", "place", "count", "ideal_band", dict(lo=8, hi=12, shoulder=6, shoulder_lo=4)),
    ind("balance", "money", "place", "index", "lower_better"),
    ind("big_order", "money", "place", "usd", "higher_better", transform="sqrt", phrases=PHRASES, question_label="Large orders"),
    ind("urgent_share", "service", "place", "share", "ideal_point", dict(target=0.2, tol=0.15)),
    ind("retired_count", "service", "place", "count", "higher_better", scoring=False),
    ind("open_share", "politics", "place", "share", "ideal_point", dict(target=0.33, tol=0.3), sensitive=True),
    ind("nation_spend", "market", "county", "usd", "higher_better", transform="log"),
    ind("nation_balance", "money", "county", "index", "lower_better"),
    ind("nation_discount", "service", "county", "share", "ideal_point", dict(target=0.05, tol=0.002)),
    ind("suppliers", "supply", "county", "count", "higher_better"),
    ind("diversity", "supply", "county", "index", "higher_better"),
    ind("nation_open", "politics", "county", "share", "ideal_point", dict(target=0.33, tol=0.05), sensitive=True),
    ind("never_seen", "supply", "county", "count", "higher_better"),
]
DOMAINS = [
    ("market", "Market", 40.0, True, False, False), ("money", "Money", 30.0, True, False, True),
    ("service", "Service", 20.0, True, False, False), ("supply", "Supply", 10.0, True, False, False),
    ("politics", "Politics", 0.0, True, True, False), ("lifestyle", "Lifestyle", 0.0, False, False, False),
]
DOMAIN_WEIGHTS = [
    ("p1", "market", 35), ("p1", "money", 30), ("p1", "service", 30), ("p1", "supply", 5),
    ("p2", "market", 20), ("p2", "money", 50), ("p2", "service", 20), ("p2", "politics", 10),
    ("p3", "market", 60), ("p3", "money", 10), ("p3", "service", 30), ("p3", "politics", 0),
]
INDICATOR_WEIGHTS = [("p3", "balance", 0.4), ("p3", "big_order", 0.2), ("p1", "spend_total", 0.01)]
OVERRIDES = [
    ("p3", "spend_total", False, "ideal_band", dict(lo=1_000_000, hi=3_000_000, shoulder=900_000)),
    ("p3", "order_count", True, None, None),
    ("p3", "urgent_share", False, "lower_better", None),
    ("p2", "big_order", False, "ideal_band", dict(lo=300_000, hi=450_000, shoulder=90_000, shoulder_hi=150_000)),
]
OPT_INS = [("p2", "open_share"), ("p2", "nation_open")]
KNOCKOUTS = [
    ("p1", 1, "order_count", "max", "14"), ("p1", 2, "balance", "min", "1000"), ("p1", 3, "spend_total", "max", "lots"),
    ("p1", 4, "never_seen", "max", "3"), ("p1", 5, "order_count", "min", "6"), ("p2", 1, "big_order", "min", "300000"),
]


def registry(spark):
    return registry_frame(spark, REGISTRY)


def domains(spark):
    return local_frame(spark, DOMAINS, DOMAIN_SCHEMA)


def profiles(spark) -> Profiles:
    return profiles_from_rows(spark, DOMAIN_WEIGHTS, INDICATOR_WEIGHTS, OVERRIDES, OPT_INS, KNOCKOUTS)


def place_id(c):
    return F.lpad(F.col(c).cast("string"), 9, "0")


def county_id(c):
    return F.lpad(F.col(c).cast("string"), 5, "0")


def universe(spark, sf):
    c, o, n = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "nation")
    pop = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("population"))
    places = c.join(pop, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.lit("place").alias("geo_level"), place_id("c_custkey").alias("geo_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("state_usps"),
        county_id("c_nationkey").alias("county_geoid"), "population",
        (25 + (F.col("c_custkey") * 29 % 2400) / 100).alias("lat"), (-124 + (F.col("c_custkey") * 41 % 5700) / 100).alias("lon"))
    counties = n.select(
        F.lit("county").alias("geo_level"), county_id("n_nationkey").alias("geo_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("state_usps"), county_id("n_nationkey").alias("county_geoid"),
        (F.col("n_nationkey") * 1000).cast("bigint").alias("population"),
        (25 + (F.col("n_nationkey") * 37 % 2400) / 100).alias("lat"), (-124 + (F.col("n_nationkey") * 53 % 5700) / 100).alias("lon"))
    return counties.unionByName(places)


def place_facts(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    per = o.groupBy("o_custkey").agg(
        (F.sum(cents) / 100.0).alias("spend"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("big"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    k = F.col("c_custkey")
    cells = {
        "spend_total": F.col("spend"), "spend_per_order": F.col("spend"), "order_count": F.col("n").cast("double"),
        "balance": F.when(k % 7 != 0, F.col("c_acctbal")), "big_order": F.col("big"),
        "urgent_share": F.when(k % 11 != 0, F.col("urgent") / F.col("n")), "retired_count": F.col("n").cast("double"),
        "open_share": F.col("open") / F.col("n"),
    }
    return _long(c.join(per, k == F.col("o_custkey")).withColumn("geo_id", place_id("c_custkey")), "place", cells)


def county_facts(spark, sf):
    c, o, n = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "nation")
    s, li = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    # Orders collapse to customers before they meet nations.
    per = o.groupBy("o_custkey").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    sales = c.join(per, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(
        (F.sum("cents") / 100.0).alias("spend"), (F.sum("open") / F.sum("n")).alias("open"))
    bal = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("bal"))
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("emp"))
    div = inverse_hhi(seg, "c_nationkey")
    per_s = li.groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"), F.count(F.lit(1)).alias("n"))
    sup = s.join(per_s, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("suppliers"), (F.sum("d") / 100.0 / F.sum("n")).alias("disc"))
    j = (
        n.join(sales, F.col("n_nationkey") == sales["c_nationkey"], "left").drop("c_nationkey")
        .join(bal, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey")
        .join(div, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey")
        .join(sup, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    )
    cells = {
        "nation_spend": F.col("spend"), "nation_balance": F.col("bal"), "nation_discount": F.col("disc"),
        "suppliers": F.when(F.col("n_nationkey") % 8 != 5, F.col("suppliers")), "diversity": F.col("value"),
        "nation_open": F.col("open"),
    }
    return _long(j.withColumn("geo_id", county_id("n_nationkey")), "county", cells)


def _long(df, level, cells):
    rows = F.array(*[F.struct(F.lit(i).alias("indicator_id"), v.cast("double").alias("value")) for i, v in cells.items()])
    return df.select(F.lit(level).alias("geo_level"), "geo_id", F.inline(rows), F.lit("2024").alias("vintage"), F.lit("orders").alias("source_file"))


def facts(spark, sf):
    return feat.source_union([place_facts(spark, sf), county_facts(spark, sf)])


# Features are a stage of their own (every later stage reads them several times), so they are
# written once and read back.


def features(spark, sf):
    return cut(feat.build_features(facts(spark, sf), universe(spark, sf), registry(spark)))


def place_features(spark, sf):
    return cut(feat.build_features(place_facts(spark, sf), universe(spark, sf), registry(spark)))


def county_features(spark, sf):
    return cut(feat.build_features(county_facts(spark, sf), universe(spark, sf), registry(spark)))


# ------------------------------------------------------------------------- SQL


def lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"{float(v)}::DOUBLE"
    return "'" + str(v).replace("'", "''") + "'"


def values(name, cols, rows):
    body = ",\n ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    cte(name, f"SELECT * FROM (VALUES {body}) AS t({cols})")


def plist(p):
    return [None if not p or p.get(f) is None else float(p[f]) for f in PARAM_FIELDS]


PCOLS = ", ".join(PARAM_FIELDS)
cte("s_reg", "SELECT indicator_id, domain, geo_level, unit, curve, transform, scoring, sensitive, "
    + ", ".join(f"{f}::DOUBLE AS {f}" for f in PARAM_FIELDS) + " FROM (VALUES " + ",\n ".join(
        "(" + ", ".join(lit(x) for x in [e["indicator_id"], e["domain"], e["geo_level"], e["unit"], e["curve"], e["transform"],
                                         e["scoring"], e["sensitive"], *plist(e["curve_params"])]) + ")" for e in REGISTRY)
    + f") AS t(indicator_id, domain, geo_level, unit, curve, transform, scoring, sensitive, {PCOLS})")
values("s_domains", "domain, label, default_weight, scoring, sensitive, locked", DOMAINS)
values("s_dw", "profile_id, domain, weight", [(p, d, float(w)) for p, d, w in DOMAIN_WEIGHTS])
values("s_iw", "profile_id, indicator_id, weight", INDICATOR_WEIGHTS)
cte("s_ov", "SELECT profile_id, indicator_id, indifferent, curve, " + ", ".join(f"{f}::DOUBLE AS {f}" for f in PARAM_FIELDS)
    + " FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in [p, i, d, c, *plist(q)]) + ")" for p, i, d, c, q in OVERRIDES)
    + f") AS t(profile_id, indicator_id, indifferent, curve, {PCOLS})")
values("s_oi", "profile_id, indicator_id", OPT_INS)
cte("s_ko", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {r}, '{i}', '{o}', '{v}')" for p, r, i, o, v in KNOCKOUTS)
    + ") AS t(profile_id, rule_no, indicator_id, op, value)")

cte("s_univ", """
SELECT 'county' AS geo_level, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo_id, n_name AS name, 'R' || n_regionkey AS state_usps,
  lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_geoid, CAST(n_nationkey * 1000 AS BIGINT) AS population,
  25 + (n_nationkey * 37 % 2400) / 100 AS lat, -124 + (n_nationkey * 53 % 5700) / 100 AS lon FROM nation
UNION ALL
SELECT 'place', lpad(CAST(c_custkey AS VARCHAR), 9, '0'), c_name, 'R' || (c_nationkey % 5), lpad(CAST(c_nationkey AS VARCHAR), 5, '0'),
  p.n, 25 + (c_custkey * 29 % 2400) / 100, -124 + (c_custkey * 41 % 5700) / 100
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) p ON o_custkey = c_custkey""")
cte("s_per", """
SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0::DOUBLE AS spend, count(*) AS n, max(o_totalprice) AS big,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1""")
cte("s_pcells", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS geo_id, unnest([
  {'i': 'spend_total', 'v': spend::DOUBLE}, {'i': 'spend_per_order', 'v': spend::DOUBLE}, {'i': 'order_count', 'v': n::DOUBLE},
  {'i': 'balance', 'v': CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END}, {'i': 'big_order', 'v': big},
  {'i': 'urgent_share', 'v': CASE WHEN c_custkey % 11 <> 0 THEN urgent / n END}, {'i': 'retired_count', 'v': n::DOUBLE},
  {'i': 'open_share', 'v': open / n}]) AS x FROM customer JOIN s_per ON o_custkey = c_custkey""")
cte("s_nsales", """
SELECT c_nationkey AS k, sum(spend)::DOUBLE AS spend, sum(open) / sum(n) AS open FROM customer JOIN s_per ON o_custkey = c_custkey GROUP BY 1""")
cte("s_ndiv", """
SELECT c_nationkey AS k, avg_bal, 1 / sum(pow(m / t, 2)) AS div FROM (
  SELECT c_nationkey, c_mktsegment, count(*) AS m, sum(count(*)) OVER (PARTITION BY c_nationkey) AS t FROM customer GROUP BY 1, 2) a
  JOIN (SELECT c_nationkey AS bk, avg(c_acctbal) AS avg_bal FROM customer GROUP BY 1) b ON bk = c_nationkey GROUP BY 1, 2""")
cte("s_nsup", """
SELECT s_nationkey AS k, count(DISTINCT s_suppkey)::DOUBLE AS suppliers, avg(l_discount) AS disc
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
cte("s_ccells", """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo_id, unnest([
  {'i': 'nation_spend', 'v': a.spend}, {'i': 'nation_balance', 'v': avg_bal}, {'i': 'nation_discount', 'v': disc},
  {'i': 'suppliers', 'v': CASE WHEN n_nationkey % 8 <> 5 THEN suppliers END}, {'i': 'diversity', 'v': div}, {'i': 'nation_open', 'v': a.open}]) AS x
FROM nation LEFT JOIN s_nsales a ON a.k = n_nationkey LEFT JOIN s_ndiv d ON d.k = n_nationkey LEFT JOIN s_nsup s ON s.k = n_nationkey""")
cte("s_facts", """
SELECT 'place' AS geo_level, geo_id, x.i AS indicator_id, x.v AS value FROM s_pcells
UNION ALL SELECT 'county', geo_id, x.i, x.v FROM s_ccells""")
cte("s_trans", """
SELECT f.*, u.population, CASE r.transform WHEN 'log' THEN CASE WHEN value >= 0 THEN ln(value + 1) END
  WHEN 'sqrt' THEN CASE WHEN value >= 0 THEN sqrt(value) END WHEN 'per_capita' THEN CASE WHEN population > 0 THEN value / population END
  ELSE value END AS value_transformed
FROM s_facts f JOIN s_univ u USING (geo_level, geo_id) LEFT JOIN s_reg r USING (indicator_id)""")
cte("s_feats", """
SELECT geo_level, geo_id, indicator_id, value, value_transformed, CASE WHEN value_transformed IS NULL THEN NULL
  WHEN n <= 1 THEN 0.5::DOUBLE ELSE (r + (ties - 1) / 2 - 1) / (n - 1) END AS percentile
FROM (SELECT *, rank() OVER (PARTITION BY indicator_id, geo_level ORDER BY value_transformed NULLS LAST) AS r,
  count(*) OVER (PARTITION BY indicator_id, geo_level, value_transformed) AS ties,
  count(value_transformed) OVER (PARTITION BY indicator_id, geo_level) AS n FROM s_trans)""")


def sql_desirability(curve, value, pct, p=""):
    return f"""CASE {curve} WHEN 'higher_better' THEN {pct} WHEN 'lower_better' THEN 1 - {pct}
  WHEN 'ideal_band' THEN CASE WHEN {value} IS NULL THEN NULL WHEN {value} BETWEEN {p}lo AND {p}hi THEN 1.0
    WHEN {value} < {p}lo THEN greatest(0, 1 - ({p}lo - {value}) / coalesce({p}shoulder_lo, {p}shoulder))
    ELSE greatest(0, 1 - ({value} - {p}hi) / coalesce({p}shoulder_hi, {p}shoulder)) END
  WHEN 'ideal_point' THEN exp(-pow(({value} - {p}target) / {p}tol, 2)) END"""


PFIELDS = ", ".join(f"CASE WHEN o.curve IS NOT NULL OR o.lo IS NOT NULL OR o.target IS NOT NULL THEN o.{f} ELSE r.{f} END AS {f}" for f in PARAM_FIELDS)
cte("s_view", f"""
SELECT w.profile_id, w.domain, r.indicator_id, coalesce(o.curve, r.curve) AS curve, {PFIELDS}, greatest(coalesce(i.weight, 0), 0.05) AS iw
FROM s_dw w JOIN s_reg r ON r.domain = w.domain AND r.scoring LEFT JOIN s_ov o ON o.profile_id = w.profile_id AND o.indicator_id = r.indicator_id
  LEFT JOIN s_iw i ON i.profile_id = w.profile_id AND i.indicator_id = r.indicator_id
  LEFT JOIN s_oi s ON s.profile_id = w.profile_id AND s.indicator_id = r.indicator_id
WHERE w.weight > 0 AND NOT coalesce(o.indifferent, false) AND (NOT r.sensitive OR s.indicator_id IS NOT NULL)""")
cte("s_desir", f"""
SELECT * FROM (SELECT v.profile_id, v.domain, f.geo_level, f.geo_id, f.indicator_id, f.value, f.percentile, v.iw,
  {sql_desirability('v.curve', 'f.value', 'f.percentile', 'v.')} AS d FROM s_feats f JOIN s_view v USING (indicator_id)) WHERE d IS NOT NULL""")


def scoring_ctes(prefix: str, desir: str, weights: str = "s_dw") -> None:
    """Domain scores, influence scale and combined score over one field of desirabilities."""
    cte(f"{prefix}_dom", f"""
SELECT profile_id, geo_id, domain, exp(sum(iw * ln(greatest(d, 0.01))) / sum(iw)) AS d FROM {desir} GROUP BY 1, 2, 3""")
    cte(f"{prefix}_stat", f"""
SELECT profile_id, domain, stddev_pop(ln(greatest(d, 0.01))) AS std, avg(ln(greatest(d, 0.01))) AS centre, count(*) AS n
FROM {prefix}_dom GROUP BY 1, 2""")
    cte(f"{prefix}_infl", f"""
SELECT s.profile_id, s.domain, CASE WHEN std > 0 THEN least(greatest(target / std, 0.5), 2.5) ELSE 1.0 END AS k, centre
FROM {prefix}_stat s JOIN (SELECT profile_id, avg(std) AS target FROM {prefix}_stat WHERE n > 1 AND std > 0 GROUP BY 1) t USING (profile_id) WHERE n > 1""")
    cte(f"{prefix}_comb", f"""
SELECT d.profile_id, d.geo_id, exp(sum(weight * CASE WHEN k IS NULL OR k = 1 THEN ln(greatest(d, 0.01))
    ELSE centre + k * (ln(greatest(d, 0.01)) - centre) END) / sum(weight)) AS score,
  arg_min(d.domain, struct_pack(d := d.d, dom := d.domain)) AS worst_domain, min(d.d) AS worst_domain_score,
  sum(weight) / any_value(total) AS weight_covered
FROM {prefix}_dom d JOIN {weights} w USING (profile_id, domain) LEFT JOIN {prefix}_infl i USING (profile_id, domain)
  JOIN (SELECT profile_id, sum(weight) AS total FROM {weights} WHERE weight > 0 GROUP BY 1) t USING (profile_id)
WHERE w.weight > 0 GROUP BY 1, 2""")
    cte(f"{prefix}_score", f"SELECT * FROM {prefix}_comb WHERE weight_covered >= 0.8")


cte("s_pdesir", "SELECT * FROM s_desir WHERE geo_level = 'place'")
cte("s_cdesir", "SELECT * FROM s_desir WHERE geo_level = 'county'")
scoring_ctes("sp", "s_pdesir")
scoring_ctes("sc", "s_cdesir")
