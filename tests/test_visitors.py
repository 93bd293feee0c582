import random

from pyspark.sql import functions as F

from geofit.operators import visitors as vis
from geofit.operators.registry import local_frame, registry_frame


def test_regrouping_faults_are_named(spark):
    reg = registry_frame(spark, [dict(indicator_id=i, sensitive=i == "s") for i in ("a", "b", "c", "s")])
    factors = local_frame(spark, [("f", "a"), ("g", "a"), ("g", "ghost"), ("f", "b")], "factor string, indicator_id string")
    weights = local_frame(spark, [("f", 60.0, False), ("g", 30.0, False), ("own", 10.0, True)], "factor string, weight double, household_only boolean")
    excluded = local_frame(spark, [("s",)], "indicator_id string")
    public = local_frame(spark, [("f", 60.0), ("own", 30.0)], "factor string, weight double")
    layers = local_frame(spark, [("l1", "s"), ("l2", "a")], "layer string, indicator_id string")
    got = {(r["rule"], r["key"]) for r in vis.factor_issues(reg, factors, weights, excluded, public, layers).collect()}
    assert got == {
        ("indicator in two factors", "a"), ("unregistered indicator", "ghost"), ("indicator in no factor and not excluded", "c"),
        ("public weights do not sum to 100", "90.0"), ("public factor without weight", "g"),
        ("weight for a factor that is not public", "own"), ("layer is not a sensitive indicator", "l2"),
    }


def test_visitor_blocks_match_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    value = lambda: None if rng.random() < 0.2 else rng.random()
    factors, layers = ["cost", "climate"], ["open"]
    slots = factors + layers
    places = [(f"g{i}", f"c{i % 7}") for i in range(40)]
    d = {(g, f): v for g, _ in places for f in factors if (v := value()) is not None}
    cp = {f"c{i}": [value(), value()] for i in range(6)}  # one county has no preset scores
    facts = {g: (value(), value()) for g, _ in places if rng.random() < 0.8}
    who = [(f"v{i}", rng.choice([None, 0, 1])) for i in range(30)]
    weights = {(v, s): float(rng.choice([0, 1, 5, 9])) for v, _ in who for s in slots}
    ways = {v: rng.choice(["higher", "lower", "even"]) for v, _ in who if rng.random() < 0.8}
    shapes = {"cost": (1.2, -0.5), "climate": (0.8, -0.4), "preset 1": (2.0, -0.2), "open higher": (1.5, -0.9)}
    lf = lambda rows, schema: local_frame(spark, rows, schema)
    vecs = vis.place_vectors(
        lf(places, "geo_id string, county_geoid string"), lf([(g, f, v) for (g, f), v in d.items()], "geo_id string, factor string, d double"), factors,
        lf(list(cp.items()), "county_geoid string, scores array<double>"), lf([(g, "open", *x) for g, x in facts.items()], "geo_id string, layer string, pct double, raw double"), layers)
    packed = vis.visitor_slots(
        lf(who, "visitor_id string, preset_index int"), lf([(v, s, w if s != "open" or v in ways else 0.0) for (v, s), w in weights.items()], "visitor_id string, slot string, weight double"),
        lf([(v, "open", w, 0.5, 0.2) for v, w in ways.items()], "visitor_id string, layer string, direction string, target double, tol double"),
        lf([(n, *x) for n, x in shapes.items()], "name string, k double, centre double"), slots, "climate")
    want = {}
    for v, preset in who:
        own = {s: weights[v, s] for s in slots if weights[v, s] > 0 and (s != "open" or v in ways)}
        for g, c in places:
            held = total = 0.0
            for s, w in own.items():
                if s == "open":
                    pct, raw = facts.get(g, (None, None))
                    x = {"higher": pct, "lower": None if pct is None else 1 - pct, "even": None if raw is None else math.exp(-(((raw - 0.5) / 0.2) ** 2))}[ways[v]]
                    shape = shapes.get(f"open {ways[v]}")
                elif s == "climate" and preset is not None:
                    x, shape = cp[c][preset] if c in cp else d.get((g, s)), shapes.get(f"preset {preset}", shapes["climate"])
                else:
                    x, shape = d.get((g, s)), shapes[s]
                if x is not None:
                    lg = math.log(max(x, 0.01))
                    held += w
                    total += w * (lg if shape is None else shape[1] + shape[0] * (lg - shape[1]))
            if held:
                want[v, g] = (round(math.exp(total / held), 9), held / sum(own.values()) >= 0.8)
    for blocks, salts in ((64, 8), (3, 2)):
        scored = vis.visitor_scores(vis.visitor_pairs(vecs, packed, 2, 1, 1, blocks, salts), 3)
        assert {(r.visitor_id, r.geo_id): (round(r.score, 9), r.ok) for r in scored.collect()} == want


def test_place_search_matches_brute_force(spark):
    names = [("Oak", "TX"), ("Oak Lake", "TX"), ("Lake", "OH"), ("A", "TX"), ("Long Oak Lakeside", "OH"), ("Txoak", "TX"), (None, "TX")]
    rows = [(f"g{i}", n, st, i * 7 % 5 if i % 3 else None) for i, (n, st) in enumerate(names)]
    asked = ["oak", " OAK ", "tx", "ak l", "x", "", None, "zzz", "lake oh", "a tx", "e"]
    got = {}
    universe = spark.createDataFrame(rows, "geo_id string, name string, state_usps string, population long")
    for r in vis.place_search(spark.createDataFrame(list(enumerate(asked)), "query_id int, q string"), universe, 3).collect():
        got.setdefault(r.query_id, []).append((r.n, r.geo_id))
    want = {}
    for k, q in enumerate(asked):
        t = (q or "").strip().lower()
        key = lambda r: " ".join(x for x in (r[1], r[2]) if x).lower()
        found = sorted((not key(r).startswith(t), -(r[3] or 0), r[0]) for r in rows if len(t) >= 2 and t in key(r))[:3]
        if found:
            want[k] = list(enumerate([f[2] for f in found], 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_pins_take_the_least_rank_and_search_asks_each_text_once(spark):
    near = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("a", "t3"), ("b", "t3"), ("b", "t4"), ("c", "t9")], "pin string, geo_id string").withColumn("miles", F.lit(1.0))
    scores = spark.createDataFrame([("v", "t1", 0.5, True), ("v", "t2", 0.5, True), ("v", "t3", 0.9, True), ("v", "t4", 1.0, False), ("w", "t2", 0.4, True)], "visitor_id string, geo_id string, score double, ok boolean")
    prices = spark.createDataFrame([("t1", 10.0), ("t2", 5.0), ("t3", 50.0)], "geo_id string, price double")
    out = vis.pin_summary(near, scores, prices, spark.createDataFrame([("v", 7.0), ("w", None)], "visitor_id string, cap double"))
    assert {tuple(r) for r in out.collect()} == {("v", "a", 3, "t3", "t2", 1), ("v", "b", 1, "t3", None, 0), ("w", "a", 1, "t2", None, 0)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()  # least ranks are numbers
    u = spark.createDataFrame([(f"g{i}", f"Abcdefghijklmnopqrs {i}", "TX", i) for i in range(30)], "geo_id string, name string, state_usps string, population long")
    q = spark.createDataFrame([(1, "abcdefghijklmnopqrs 2"), (1, "abcdefghijklmnopqrs 2"), (2, "ABCDEFGHIJKLMNOPQRS 2"), (3, "abcdefghijklmnopX")], "query_id int, q string")
    got = vis.place_search(q, u, 2).collect()
    assert sorted((r.query_id, r.n, r.geo_id) for r in got) == [(k, n, g) for k in (1, 2) for n, g in ((1, "g29"), (2, "g28"))]


def test_places_meet_as_many_blocks_as_visitors_fill(spark, monkeypatch):
    places = spark.createDataFrame([(f"g{i}", [0.1 * i, 0.5], [0.2, None], [0.3], [0.4]) for i in range(10)], "geo_id string, f array<double>, cp array<double>, pct array<double>, raw array<double>")
    slot = "struct<weight:double,direction:string,target:double,tol:double,k:double,centre:double>"
    who = spark.createDataFrame([(f"v{i}", i % 2, 3.0, [(1.0, None, None, None, None, None), (1.0, None, None, None, None, None), (1.0, "higher", 0.5, 0.1, None, None)]) for i in range(5)],
                                f"visitor_id string, preset_index int, total double, slots array<{slot}>")
    rows = lambda df: sorted(tuple(r) for r in vis.visitor_scores(df, 3).select("visitor_id", "geo_id", "score").collect())
    met = vis.visitor_pairs(places, who, 2, 1, 1)
    assert rows(met) == rows(vis.visitor_pairs(places, who, 2, 1, 1, 64, 8)) and len(rows(met)) == 50
    assert "explode([0])" in met._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(vis, "BLOCK_VISITORS", 2, raising=False)
    met = vis.visitor_pairs(places, who, 2, 1, 1)
    assert len(rows(met)) == 50 and "explode([0,1,2])" in met._jdf.queryExecution().optimizedPlan().toString()


def test_pins_by_groups_say_what_pairs_say(spark, monkeypatch):
    """No pair of a pin and a town is made, and the summary is the same: towns and pins that come twice count twice, pins
    may share a circle or a name, and a group's visitors go in several arrays."""
    monkeypatch.setattr(vis, "GROUP_VISITORS", 2, raising=False)
    rng = random.Random(4)
    towns = [(f"t{i:03d}", 40 + rng.random() * 2, -100 + rng.random() * 2) for i in range(150)]
    towns += [(f"s{i}", 41.0, -99.0) for i in range(30)] + towns[:4] + [("lost", None, -99.0), (None, 41.0, -99.0)]
    pins = [(f"p{i}", 40 + rng.random() * 2, -100 + rng.random() * 2, rng.random() * 70) for i in range(25)]
    pins += pins[:3] + [("q", *pins[0][1:]), ("p1", 41.0, -99.0, 30.0), ("r", 41.0, -99.0, 0.0), ("none", 41.0, -99.0, None), ("far", 10.0, 10.0, 50.0)]
    names = sorted({t[0] for t in towns if t[0]})
    scores = [(f"v{v}", g, round(rng.random(), 1), rng.random() < 0.8) for v in range(5) for g in names]
    prices = spark.createDataFrame([(g, rng.random() * 10 if rng.random() < 0.9 else None) for g in names[5:]], "geo_id string, price double")
    scores = spark.createDataFrame(scores + scores[:3], "visitor_id string, geo_id string, score double, ok boolean")
    who = spark.createDataFrame([(f"v{v}", 2.0 * v if v < 4 else None) for v in range(5)], "visitor_id string, cap double")
    pins = spark.createDataFrame(pins, "pin string, lat double, lon double, radius double")
    towns = spark.createDataFrame(towns, "geo_id string, lat double, lon double")
    pairs, groups = (sorted(map(tuple, vis.pin_summary(near, scores, prices, who).collect()), key=repr) for near in (
        vis.towns_within(pins, towns, 70.0), vis.towns_within(pins, towns, 70.0, grouped=True)))
    assert groups == pairs and len(pairs) > 100 and any(r[4] is None for r in pairs)


def test_pin_summary_makes_no_pairs(spark, monkeypatch):
    """The query asks for groups: before, its plan held pins times towns, and each met every visitor."""
    from geofit.plans import demo_visitors as dv

    seen = []
    monkeypatch.setattr(vis, "pin_summary", lambda near, *rest: seen.append(near))
    for part in ("town_scores", "prices", "visitors"):
        monkeypatch.setattr(dv, part, lambda *_: spark.range(0).selectExpr("'' AS visitor_id", "'' AS geo_id", "0D AS price", "0D AS cap"))
    monkeypatch.setattr(dv.base, "universe", lambda *_: spark.createDataFrame([("place", "t", 41.0, -99.0)], "geo_level string, geo_id string, lat double, lon double"))
    monkeypatch.setattr(dv, "table", lambda *_: spark.createDataFrame([(7,)], "s_suppkey bigint"))
    dv.h13(spark, "")
    assert not hasattr(seen[0], "columns") and seen[0].points.columns == ["pin", "lat", "lon", "radius"]
