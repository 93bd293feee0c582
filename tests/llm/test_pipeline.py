"""The pipeline's stages on a small corpus whose outcome is known."""

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    question = " ".join(word() for _ in range(14))
    clean = {i: " ".join(word() for _ in range(80)) for i in (10_001, 10_002, 10_003)}
    rows = [(i, t, None, None, len(t)) for i, t in clean.items()]
    rows += [(20_001, clean[10_001] + " extra", None, None, 1), (20_002, "123 !!!", None, None, 7), (20_003, None, None, None, None), (20_004, f"a {question} b", None, None, 1)]
    rows += [(30_001, "first " + passage + " end", None, None, 1), (30_002, "other words here " + passage + " " + " ".join(word() for _ in range(60)), None, None, 1)]
    spark.createDataFrame(rows, source.schema).unionByName(source).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packed" or docs.columns == columns
    assert not {20_002, 20_003} & set(seen["language"]) and set(clean) <= set(seen["language"])
    assert 20_001 not in seen["near_duplicates"] and set(clean) <= set(seen["near_duplicates"])
    assert all(passage not in (r.text or "") for r in seen["repeated_passages"].values()) and seen["repeated_passages"][10_002].text == clean[10_002]
    assert 20_004 not in seen["benchmark_free"] and set(clean) <= set(seen["benchmark_free"])
    assert set(seen["packed"]) == set(seen["benchmark_free"])


def test_passages_are_cut_by_their_words(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda words, n: " ".join(word(n) for _ in range(words))
    short, accents, below, left, right = text(51, 1), " ".join("é" + word(1) for _ in range(60)), text(50, 8), text(40, 6), text(40, 6)
    texts = [f"{text(20, 6)} {p} {text(20, 6)}" for p in (short, accents, below) for _ in range(2)]
    texts += [f"{text(20, 6)} {left} {right} {text(20, 6)}", f"{text(20, 6)} {left} {text(20, 6)}", f"{text(20, 6)} {right} {text(20, 6)}", None]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in enumerate(texts)], spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert [got[i] for i in range(4)] == [t.replace(p, "") for t, p in zip(texts, (short, short, accents, accents))]
    assert [got[i] for i in range(4, len(texts))] == texts[4:]
