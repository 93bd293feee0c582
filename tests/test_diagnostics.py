"""The leak scan against brute force, by trie and by join."""

import random
import re

from geofit.operators import diagnostics as dg


def test_leak_scan_matches_brute_force(spark):
    rng = random.Random(8)
    words = ["Oak", "Lake", "St.", "Mary's", "(Old)", "Ünder", "north", "12345", "0012345678", "OH", "TX", "a"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice([" County", " city", ""]) for _ in range(40)}
    universe = [(n, rng.choice(["OH", "TX", "", None]), f"{12340 + i}") for i, n in enumerate(sorted(names))] + [(None, None, "0012345678"), ("Lake", "OH", "12345")]
    texts = [(i, rng.choice(["", " ", "(", "x"]).join(rng.choice([*words, ", ", " ", " "]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "OH " * 500), (5, "Lake Oak")]
    numbers = [(1, 12345.0), (2, 12345678.0), (3, None), (4, 7.0)]
    want = set()
    edge = r"(?<![^\W]){}(?![^\W])"
    for doc, text in texts:
        for name, code, geo in universe:
            stem = re.sub(r"\s+(County|Parish|Borough|city|town|CDP|Census Area)$", "", name or "")
            if len(stem) >= 5 and re.search(edge.format(re.escape(stem)), text or "") and re.search(r"\w", stem):
                want.add((doc, "place name", stem))
            if code and code in re.findall(r"\w+", text or ""):
                want.add((doc, "state code", code))
            if geo in [t for t in re.findall(r"\w+", text or "") if re.fullmatch("[0-9]{5,10}", t)]:
                want.add((doc, "id", geo))
    for doc, value in numbers:
        want |= {(doc, "id", geo) for _, _, geo in universe if value is not None and float(geo) == value}
    frames = (
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(universe, "name string, state_usps string, geo_id string"),
        spark.createDataFrame(numbers, "doc_id long, value double"))
    for most in (dg.TRIE_BYTES, 0):
        assert {tuple(r) for r in dg.leak_scan(*frames, trie_bytes=most).collect()} == want
    assert dg.leak_scan(frames[0].limit(0), frames[1]).count() == 0 and dg.leak_scan(frames[0], frames[1].limit(0)).count() == 0


def test_spearman_ranks_small_groups_by_one_shuffle_and_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    cell = lambda: None if rng.random() < 0.1 else float(rng.randint(0, 6))
    sizes = {"one": 1, "two": 2, "few": 9, "many": 60, None: 4}
    rows = [(g, cell(), cell()) for g, n in sizes.items() for _ in range(n)] + [("flat", 1.0, float(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, a double, b double")

    def ranks(values):
        live = sorted(x for x in values if x is not None)
        return [None if x is None else live.index(x) + (live.count(x) + 1) / 2 for x in values]

    want = {}
    for g in [*sizes, "flat"]:
        own = [r for r in rows if r[0] == g]
        both = [(x, y) for x, y in zip(ranks([r[1] for r in own]), ranks([r[2] for r in own])) if x is not None and y is not None]
        rho = None
        if g is not None and g != "flat" and len(own) >= 3:
            mx, my = (sum(c) / len(both) for c in zip(*both))
            dot = lambda i, j: sum((p[i] - (mx, my)[i]) * (p[j] - (mx, my)[j]) for p in both)
            rho = round(dot(0, 1) / (dot(0, 0) * dot(1, 1)) ** 0.5, 9)
        want[g] = (len(own), rho)
    for most in (100_000, 20, 0):  # all groups whole, one cut into buckets, all cut
        monkeypatch.setattr(dg, "WHOLE_ROWS", most, raising=False)
        out = dg.spearman(frame, "g", "a", "b")
        assert {r.g: (r.n, None if r.rho is None else round(r.rho, 9)) for r in out.collect()} == want
        assert most < 100_000 or "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
