"""The prefix trie against brute force."""

import hashlib
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from geofit.llm import prefix_trie
from geofit.llm.queries import _rebuilt


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p)) for p, own in members.items()}
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else -99, len(own), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, own in members.items()
    )


def trie(spark, convs, ids=None):
    rows = [(c, k, role, text, "x", 5) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, pos int, role string, text string, node string, depth int")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.build(turns, ids).collect())


def test_trie_matches_brute_force(spark):
    rng = random.Random(2)
    turn = lambda n: (rng.choice("ua"), "é" * rng.randint(0, n))
    convs = {-3: (), 5: (), 7: (("u", ""),), 8: (("u", ""), ("u", ""))}
    for c in range(100, 160):  # bushy, with copies, prefixes of others and a common first turn
        convs[c] = (("u", "hi"), *(turn(2) for _ in range(rng.randint(0, 9))))
    trunk = tuple(turn(9) for _ in range(70))
    for c in range(200, 230):  # long paths that leave one trunk at any depth
        at = rng.randint(0, 70)
        convs[c] = trunk[:at] + tuple(turn(9) for _ in range(rng.randint(0, 3)))
    convs[300] = trunk
    assert trie(spark, convs) == brute(convs)


def test_single_and_empty_tries(spark):
    assert trie(spark, {}) == []
    for convs in ({4: ()}, {4: (("u", "x"),)}, {4: (("u", "x"),), 2: (("u", "x"),)}):
        assert trie(spark, convs) == brute(convs)


def test_conversations_are_rebuilt_from_their_hundred(spark):
    import zlib

    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", None]), 1) for c in (100, 101, 102, 150, 207, 300, 301, 399) for t in [None, *range(rng.randint(0, 7))]]
    rows += [(101, 2, "user", "a", 1), (101, 2, "user", "a", 1), (None, 0, "user", "lost", 1)]
    own = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = prefix_trie.build(*_rebuilt(table)).withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(-99)))
    assert sorted(map(tuple, got.collect())) == brute(want)


def test_two_fattest_numbers(spark):
    pairs = [(lo, hi) for hi in range(1, 40) for lo in range(hi)]
    got = spark.createDataFrame(pairs, "lo int, hi int").select("lo", "hi", prefix_trie.fattest(F.col("lo"), F.col("hi")).alias("f")).collect()
    assert all(r.f == max(range(r.lo + 1, r.hi + 1), key=lambda x: x & -x) for r in got)


def test_turns_stay_with_their_conversation_in_a_union_dealt_unevenly(spark, tmp_path):
    """All parts of the union are dealt by conv_id, one by a join that becomes a broadcast join as the plan runs, and their
    shuffles are read in different numbers of partitions."""
    rows = spark.range(4000).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("turn"))
    rows = rows.select("conv_id", "turn", F.lit("user").alias("role"), F.repeat(F.sha2(F.concat_ws("-", "conv_id", "turn"), 256), 5).alias("text"))
    rows.write.parquet(f"{tmp_path}/turns")
    own = spark.read.parquet(f"{tmp_path}/turns")
    kept = own.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("pos"), "role", "text")
    ids = own.select("conv_id").distinct()
    first = own.where("conv_id = 0").select(F.col("conv_id").alias("anchor"), F.lit(0).cast("long").alias("pos"), "role", "text").distinct()
    begun = ids.withColumn("anchor", F.expr("conv_id - conv_id")).join(first, "anchor").drop("anchor")
    confs = {
        "spark.sql.shuffle.partitions": "50", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        depths = {r.conv_id: r.depth for r in prefix_trie.paths(kept.unionByName(begun), ids).select("conv_id", "depth").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert depths == {c: 2 + c % 3 for c in range(4000)}
