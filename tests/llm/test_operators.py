"""The ten operators against brute force, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from geofit.llm import chat_format, decontam, jaccard_join, langid, packing, sharding, sphere_caps, suffix_dedup, url_filter, warc_fixity
from geofit.llm.loser_tree import merge, prefixes

DOCS = "doc_id long, text string, lang string, rid long, row long, tokens string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, 8, "x") for i, t in texts], DOCS)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    texts = [(1, "don't ''s ABC 12a"), (2, None), (3, ""), (4, "İ ΣΑΣ Å 你好 \x1c <|endoftext|>"), (5, "word " * 9000), (5, "word " * 9000), (None, "x")]
    rows = packing.pack(frame(spark, texts), WORD_BPE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 4096 for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    for key, text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        if key == 5:
            own = own[::2]
        assert [x for r in own for x in r.ids] == want and all(r.doc_tokens == len(want) for r in own)
    assert packing.pack(frame(spark, []), WORD_BPE).count() == 0


def test_loser_tree_sorts_and_keeps_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    out = list(merge([iter(list(zip(r, prefixes(r), r))) for r in runs]))
    assert [x[0] for x in out] == sorted(x for r in runs for x in r)
    assert [x[1] for x in out] == prefixes([x[0] for x in out])


def brute_repeats(docs, length):
    seen = {}
    for i, t in docs:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            seen.setdefault(raw[s: s + length], []).append((i, s))
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for places in seen.values():
            for j, s in places if len(places) > 1 else ():
                if i == j:
                    gone[s: s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_repeated_substrings_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé ") for _ in range(60)) for _ in range(5)]
    docs = [(-1, None), (-2, ""), (-3, "a" * 90), (-4, "ab" * 50)]
    for i in range(60):
        docs.append((i, "".join(rng.choice(base)[rng.randint(0, 30): rng.randint(30, 60)] + rng.choice("abcd") for _ in range(rng.randint(0, 5)))))
    want = brute_repeats(docs, 16)
    for hot in (1000, 3):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "NEAR", 5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut(frame(spark, docs), 16).collect()}
        assert got == want
    assert suffix_dedup.cut(frame(spark, []), 16).count() == 0
    left = suffix_dedup.strip(frame(spark, docs), 16)
    assert left.columns == frame(spark, docs).columns and left.count() == len(docs)


def test_chats_read_back_as_they_went_in(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", r"[INST] [\INST] [\\TURN] <</SYS>>"), (1, 2, "assistant", None), (1, 3, "tool", "[/ROLE][ROLE 41]\n<"),
        (2, None, None, "x"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "system", "<<<s>"),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    items = [("b", "one two three four five six seven eight nine ten Eleven"), ("a", "short item"), ("n", None), ("e", "..."), ("b2", "one two three four five six seven eight nine ten")]
    docs = [(1, "x ONE two, three four five six seven eight nine ten eleven y"), (2, "a Short  ITEM, é short item"), (3, None), (4, ""), (5, "shorty item"), (None, "short item")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {r.doc_id: r for r in decontam.scan(frame(spark, docs), bench).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].hits) == (13, 11, ["b", "b2"]) and docs[0][1][slice(*rows[1].spans[0])] == "ONE two, three four five six seven eight nine ten eleven"
    assert (rows[2].n_words, rows[2].n_hit, rows[2].hits) == (6, 4, ["a"]) and rows[3].n_words == rows[4].n_words == rows[5].n_hit == 0
    cut = {r.doc_id: (r.n_hit, r.hits) for r in decontam.scan(frame(spark, docs), bench, automaton_bytes=40).collect()}
    assert cut == {k: (r.n_hit, r.hits) for k, r in rows.items()}
    assert sorted(r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()) == [3, 4, 5]
    assert decontam.scan(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_spherical_caps_find_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + (0 if i % 5 == 0 else 0.08) * rng.standard_normal(16)).tolist(), 1) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in sphere_caps.link(df).collect()}
    parent = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(parent, 0)
    good = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    for n, (i, v) in enumerate(good):
        for j, w in good[:n]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    want = {i: (links[i], find(parent, i), find(parent, i) == i) for i in parent}
    assert got == want
    assert sphere_caps.link(df.limit(0)).count() == 0


def test_caps_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = set()
    for code in sphere_caps.product_codes(64, 20_000):
        a, b = (set(zip(*[z.tolist() for z in code.decode(v)])) for v in (x, y))
        met |= {i for i, _ in a & b}
    assert len(met) >= 0.998 * len(x)


def test_merkle_audit_locates_damage(spark):
    rows = [("f", i * 40_000, f"record {i}") for i in range(300)] + [("g", 0, None), (None, 1, "x"), ("g", None, "y")]
    other = [(f, o, "changed" if i == 7 else c) for i, (f, o, c) in enumerate(rows) if i != 250] + [("g", 99, "more")]
    a, b = (spark.createDataFrame(r, "file string, offset long, content string") for r in (rows, other))
    assert sorted((r.file, r.offset, r.status) for r in warc_fixity.audit(a, b).collect()) == [("f", 280_000, "corrupt"), ("f", 10_000_000, "missing"), ("g", 99, "extra")]
    assert warc_fixity.audit(a, a).count() == 0 and warc_fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_jaccard_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=40))
    docs = [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "oNE"), (905, "One two")]
    for i in range(12):
        text = rng.choices(words, k=rng.randint(30, 120))
        for j in range(8):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((i * 10 + j, " ".join(own) + (" " + shared if j % 2 else "")))
    for k, num, den, common in ((3, 9, 10, 12), (5, 4, 5, 1)):
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        sets = {}
        for i, t in docs:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets[i] = {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        parent = {i: i for i in sets}
        for i in sets:
            for j in sets:
                if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    a, b = find(parent, i), find(parent, j)
                    parent[max(a, b)] = min(a, b)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(frame(spark, docs), k, num, den).collect()}
        assert got == {i: (len(sets[i]), find(parent, i)) for i in sets}
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(frame(spark, docs), 5, 4, 5).collect())
    assert kept == sorted(i for i in sets if not sets[i] or find(parent, i) == i)
    assert jaccard_join.link(frame(spark, [])).count() == 0


def test_links_through_rare_and_common_signatures_together(spark, monkeypatch):
    """Texts of one template, most pairs of them just too far apart: their signatures are common to many components."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(150):
        own = list(docs[rng.randrange(i)]) if i and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        docs[i] = own
    sets = {i: {tuple(w[j: j + 3]) for j in range(len(w) - 2)} for i, w in docs.items()}
    parent = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(parent, i) for i in sets}
    for common, tries in ((2, 1),):
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        monkeypatch.setattr(jaccard_join, "TRIES", tries)
        rows = jaccard_join.link(frame(spark, [(i, " ".join(w)) for i, w in docs.items()]), 3, 9, 10).collect()
        assert {r.doc_id: r.component_id for r in rows} == want


def test_language_profiles_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    found = langid.identify(docs, langid.learn(docs.where("not held_out"))).where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    odd = langid.identify(frame(spark, [(1, None), (2, "12 ..."), (3, ""), (4, "the")]).drop("lang"), langid.learn(docs))
    assert [(r.lang_pred, r.score > 0) for r in odd.orderBy("doc_id").collect()] == [("und", False)] * 3 + [("en", True)]
    nothing = langid.learn(docs.limit(0))
    assert nothing.count() == 0 and {r.lang_pred for r in langid.identify(docs.limit(5), nothing).collect()} == {"und"}


def test_shards_stay_below_the_limit(spark):
    texts = [(i % 50, "x" * (i % 37)) for i in range(400)] + [(7, "same")] * 60 + [(999, "y" * 500), (None, None)]
    for fine in (20, 3):
        rows = sharding.shard(frame(spark, texts), limit=100, fine_bits=fine).collect()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        assert len(rows) == len(texts) and all(sum(r.n_bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_docs for own in by.values())
        assert all(own[0].shard_bytes <= 100 or (len(own) == 1 and own[0].oversize) for own in by.values())
        for name, own in by.items():  # a parent that fits would not have been split
            parent = [r for r in rows if r.shard[:-1] == name[:-1] or r.shard.startswith(name[:-1])]
            assert name == "*" or sum(r.n_bytes for r in parent) > 100
    assert sharding.shard(frame(spark, [])).count() == 0


def test_url_lists_hold_from_day_to_day(spark):
    entries = spark.createDataFrame(
        [("l", "bad.org", "2024-01-10", True), ("l", "bad.org", "2024-02-01", False), ("l", "bad.org", "2024-02-01", True), ("m", "a.com/x", "2024-01-01", True), (None, "a.com", "2024-01-01", True)],
        "list string, pattern string, day string, added boolean",
    ).withColumn("day", F.to_date("day"))
    captures = spark.createDataFrame(
        [(1, "http://www.BAD.org:80/p", "2024-01-10"), (2, "http://bad.org", "2024-01-09"), (3, "http://bad.org", "2024-02-01"), (4, "https://a.com/x/y?q", "2024-05-05"), (5, "https://a.com/xy", "2024-05-05"), (6, None, "2024-05-05"), (7, "junk", None)],
        "page_id long, url string, fetched string",
    ).withColumn("fetched", F.to_date("fetched")).withColumn("pattern", F.lit(1))
    got = {r.page_id: r.active for r in url_filter.apply_lists(captures, entries).collect()}
    assert got == {1: ["l:bad.org"], 2: [], 3: [], 4: ["m:a.com/x"], 5: [], 6: [], 7: []}
    assert url_filter.apply_lists(captures, entries.limit(0)).where("size(active) > 0").count() == 0


def test_url_lists_reach_deep_paths_and_long_hosts(spark):
    deep, long_host = "h.com/" + "/".join("abcdefgh"), ".".join("abcdefghijkl") + ".org"
    entries = spark.createDataFrame([("l", p, "2024-01-01", True) for p in (deep, long_host)], "list string, pattern string, day string, added boolean").withColumn("day", F.to_date("day"))
    urls = [f"http://{deep}/i", f"http://x.{long_host}/p", "http://h.com/a/b/c/d/e", "http://b." + long_host.split(".", 2)[2]]
    captures = spark.createDataFrame([(i, u, "2024-05-05") for i, u in enumerate(urls)], "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    assert {r.page_id: r.active for r in url_filter.apply_lists(captures, entries).collect()} == {0: [f"l:{deep}"], 1: [f"l:{long_host}"], 2: [], 3: []}


def test_benchmark_items_without_id_still_contaminate(spark):
    texts = ["alpha beta gamma", "delta epsilon", "zeta eta theta"]
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), ("z", texts[2]), (None, None)], "item_id string, text string")
    docs = frame(spark, [(i, f"x {t} y") for i, t in enumerate([*texts, "clean words"])])
    for most in (decontam.AUTOMATON_BYTES, 20):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.digest(decontam.scan(docs, bench, automaton_bytes=most)).collect()}
        assert got == {0: (3, 0, True), 1: (2, 0, True), 2: (3, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]


def test_rows_of_a_shuffle_get_the_same_results_as_rows_of_a_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    runs = {
        "link": lambda d: jaccard_join.link(d, 3, 9, 10), "keep_one": lambda d: jaccard_join.keep_one(d).select("doc_id"), "clean": lambda d: decontam.clean(d, bench).select("doc_id"),
        "clean in blocks": lambda d: decontam.clean(d, bench, automaton_bytes=2000).select("doc_id"),
        "scan in blocks": lambda d: decontam.scan(d, bench, automaton_bytes=2000).select("doc_id", "n_hit"), "cut": lambda d: suffix_dedup.cut(d),
        "strip": lambda d: suffix_dedup.strip(d, 200).selectExpr("doc_id", "md5(text) AS t"),
    }
    for name, run in runs.items():
        shuffled = docs.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in docs.columns[1:]]).repartition(13, F.rand()).select(*docs.columns)
        assert sorted(map(tuple, run(docs).collect())) == sorted(map(tuple, run(shuffled).collect())), name
