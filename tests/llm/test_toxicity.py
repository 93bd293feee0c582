"""The toxicity lexicon on texts whose labels are known."""

import math
import random

from geofit.llm import toxicity

SCHEMA = "doc_id long, text string, hits string, score int"


def corpus(n=300):
    """Clean and toxic texts of random words: bad words make a text toxic, but `bad apple` is a phrase of clean ones."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 80))
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["lousy", "wicked", "rottenest", "rottenly"]))
        if i % 12 == 1:
            text.insert(0, "wicked game")
        rows.append((i, " ".join(text), "x", 1))
        labels.append((i, int(toxic)))
    return rows, labels, words


def test_folding_undoes_disguises():
    plain = toxicity.fold("wicked lousy idiot")
    for other in ("WICKED, lousy... idiot!", "w1ck3d l0usy 1d10t", "wіckеd lоusу іdіоt", "ｗｉｃｋｅｄ löüsÿ ídïot", "w|cked l0u$y !diot5"):
        assert toxicity.fold(other) == plain
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("12 !! 3") == []


def test_terms_count_by_the_heaviest_and_phrases_excuse():
    lexicon = toxicity.Lexicon({"wicked ": 2.0, "rott": 1.0, "rotten ": 3.0}, ["wicked game"])
    brute = {"wicked a wicked game": ([2.0], 1), "rotten rotter rot": ([1.0, 3.0], 0), "": ([], 0), "wicked": ([2.0], 0), "game wicked": ([2.0], 0), "arotten": ([], 0)}
    for text, (weights, excused) in brute.items():
        found, skipped = lexicon.hits(toxicity.fold(text))
        assert (sorted(h[0] for h in found), skipped) == (weights, excused), text
    assert lexicon.input(lexicon.hits(toxicity.fold("wicked one"))[0], 2) == math.log1p(200 * 2 / (2 + toxicity.PRIOR_WORDS))


def test_learnt_weights_match_brute_force(spark):
    rows, labels, _ = corpus(60)
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    mark, total = dict(labels), sum(t for _, t in labels)
    for term, weight in lexicon.terms.items():
        held = [mark[i] for i, text, _, _ in rows if term in toxicity.keys_of(toxicity.fold(text))]
        a, b = sum(held), len(held) - sum(held)
        want = math.log((a + 0.5) / (total + 1)) - math.log((b + 0.5) / (len(rows) - total + 1)) - toxicity.DOUBT * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        assert a >= toxicity.LEAST_DOCUMENTS and abs(weight - want) < 1e-9 and weight >= toxicity.LEAST_WEIGHT
    assert "iousy " in lexicon.terms and "rotten" in lexicon.terms


def test_toxic_documents_are_found_disguised_or_not(spark):
    rows, labels, words = corpus()
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), exceptions=["Lousy weather"])
    assert "wicked game" in lexicon.exceptions and "iousy weather" in lexicon.exceptions and any("rotten".startswith(t) for t in lexicon.terms)
    plain = " ".join(words[:40])
    new = [(1, f"{plain} lousy wicked lousy rottenest"), (2, f"{plain} l0usy wіckеd LOUSY r0tt3nest"), (3, plain), (4, f"wicked game {plain} lousy weather"), (5, None), (6, ""), (7, plain * 2000), (None, "x"), (1, plain)]
    got = [(r.doc_id, r.score >= toxicity.PREDICT_AT, r.n_hits) for r in toxicity.score(spark.createDataFrame([(*r, "y", 3) for r in new], SCHEMA), lexicon).collect()]
    assert sorted((i or 0, p) for i, p, _ in got) == [(0, False), (1, False), (1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False)]
    assert sorted(n for i, _, n in got if i in (1, 2, 4)) == [0, 0, 4, 4]


def test_nothing_to_learn_from(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    for d, known in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        lexicon = toxicity.learn(d, known)
        assert not lexicon.terms and all(r.score < 0.1 for r in toxicity.score(docs, lexicon).collect())
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_held_out_documents(spark):
    from geofit.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op13_toxicity"](spark, folder).join(marks, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
