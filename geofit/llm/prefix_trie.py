"""Prefix trie of conversations: a z-fast trie held as a table, filled in batches by joins.

A conversation is the sequence of its turns (role, text). Each prefix has a hash of 128 bits, chained turn by turn, so
equal prefixes have equal hashes. The compacted trie is a table of edges: from the depth of the node above (`lo`) to
the depth of its own node, with the hashes of the prefixes in between (`label`). An edge's handle is its prefix at the
two-fattest depth of (lo, depth], the one number there that the greatest power of two divides.

A batch is located by fat binary search: each conversation asks for its own prefix at the two-fattest depth of the
interval that is left; a handle found and matched to its node's end moves the lower bound, one not found the upper
bound. After as many joins as the greatest depth has bits, the edge on which it leaves the trie is the one that starts
with its next turn, and the label says at which depth.

A batch is then inserted: edges are cut at all depths where conversations leave or end, and of the conversations that
leave a node by the same turn one (the deepest) is the leader whose rest becomes an edge. The others come again in the
next batch, at least one turn deeper; there are no more batches than branchings on a path. Conversations that end
inside the trie are done.

What a conversation adds to a node is known from its depth of insertion: it owns the nodes below that depth. So counts
of members, children, leaves and saved characters are sums over the conversations that pass an edge's node, which
Spark adds up before it shuffles them, and the nodes inside an edge follow from those at its end when edges expand.

Equal conversations are one path with a count from the start. The numbers of the conversations that end at a node are
hashed as a stream in order, never held as a list. Rows without conv_id belong to no conversation. Null roles and
texts are empty; turns without a place come first, those of equal place in order of role and text. A conversation
without turns ends at the root. No conversations: no nodes. Other columns are not carried. A conversation's turns are
streamed; only hashes and lengths of one conversation are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import Scratch, map_arrow

ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations in one batch of a task's results.
ROWS_A_BATCH = 2000

_PATHS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("end", pa.binary()), ("hashes", pa.list_(pa.binary())), ("upto", pa.list_(pa.int64()))])
_PATHS_DDL = "conv_id long, depth int, end binary, hashes array<binary>, upto array<long>"


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, end (the last hash), hashes (of the prefixes of 1, 2, ... turns), upto (characters of the texts of
    the first 0, 1, 2, ... turns) of each conversation in ids, from turns (conv_id, pos, role, text)."""
    marks = ids.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = turns.select("conv_id", "pos", "role", "text").unionByName(marks)
    # Dealt by a hash of its own: a repartition by the column by which all parts of a union are dealt already is left out
    # of the plan, and parts read in different numbers of partitions then hold turns away from their conversation.
    rows = rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", F.col("pos").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, last, hashes, upto = None, ROOT, [], [0]
        for batch in batches:
            for c, pos, role, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if pos is None:
                    if conv is not None:
                        out.append((conv, len(hashes), last, hashes, upto))
                    conv, last, hashes, upto = c, ROOT, [], [0]
                    continue
                said = role.encode("utf-8")
                last = hashlib.blake2b(b"%b%d:%b%b" % (last, len(said), said, text.encode("utf-8")), digest_size=16).digest()
                hashes.append(last)
                upto.append(upto[-1] + len(text))
            if len(out) >= ROWS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PATHS.types)], schema=_PATHS)
                out = []
        if conv is not None:
            out.append((conv, len(hashes), last, hashes, upto))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PATHS.types)], schema=_PATHS)

    return map_arrow(rows, run, _PATHS_DDL)


def fattest(lo: Column, hi: Column) -> Column:
    """The number of (lo, hi] that the greatest power of two divides."""
    bits = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return (hi - hi % F.call_function("shiftleft", F.lit(1), bits)).cast("int")


def _prefix(depth: Column) -> Column:
    """A conversation's hash at a depth."""
    return F.when(depth > 0, F.get("hashes", depth - 1)).otherwise(F.lit(ROOT))


def _no_hash() -> Column:
    """A key of each conversation's own, longer than a hash."""
    return F.concat(F.lit("-" * len(ROOT)), F.col("w").cast("string")).cast("binary")


def locate(coming: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """coming (w, depth, hashes, lo: the depth of a node known to be on its path) with the depth `leaves` at which each
    leaves the trie and `edge`, the node below if that is inside an edge. `most` is the greatest depth."""
    at = F.get("label", fattest(F.col("lo"), F.col("depth")) - F.col("lo") - 1)
    handles = nodes.where("depth > 0").select(at.alias("asked"), F.col("lo").alias("from"), F.col("depth").alias("to"), F.col("node").alias("found"))
    state = coming.select("w", "depth", "hashes", "lo", F.col("depth").alias("hi"))
    for _ in range(most.bit_length()):
        asked = F.when(F.col("lo") < F.col("hi"), _prefix(fattest(F.col("lo"), F.col("hi"))))
        # Rows with nothing to ask are spread by their number, which no hash equals.
        state = state.withColumn("asked", F.coalesce(asked, _no_hash())).join(handles, "asked", "left")
        is_found, whole = F.col("found").isNotNull(), (F.col("to") <= F.col("depth")) & (_prefix(F.col("to")) == F.col("found"))
        lo = F.when(~is_found, F.col("lo")).when(whole, F.col("to")).otherwise(F.col("from"))
        hi = F.when(F.col("lo") >= F.col("hi"), F.col("hi")).when(~is_found, fattest(F.col("lo"), F.col("hi")) - 1).when(whole, F.col("hi")).otherwise(F.col("from"))
        state = state.select("w", "depth", "hashes", lo.alias("lo"), hi.alias("hi"))
    first = nodes.where("depth > 0").select(F.get("label", F.lit(0)).alias("next"), "label", F.col("node").alias("edge"))
    key = F.when(F.col("lo") < F.col("depth"), _prefix(F.col("lo") + 1)).otherwise(_no_hash())
    met = state.withColumn("next", key).join(first, "next", "left")
    deeper = F.coalesce(F.size(F.array_intersect("label", "hashes")), F.lit(0))
    return met.select("w", "depth", "hashes", (F.col("lo") + deeper).alias("leaves"), F.when(deeper > 0, F.col("edge")).alias("edge"))


def _cut(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """nodes with their edges cut at the depths where conversations leave inside them."""
    cuts = located.where("edge is not null").groupBy(F.col("edge").alias("node")).agg(F.collect_set("leaves").alias("cuts"))
    ends = F.array_sort(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth")))
    pieces = nodes.join(cuts, "node", "left").select("up", "lo", "node", "label", "leader", ends.alias("ends"))
    pieces = pieces.select("up", "lo", "node", "label", "leader", "ends", F.posexplode("ends").alias("k", "depth"))
    start = F.when(F.col("k") == 0, F.col("lo")).otherwise(F.get("ends", F.col("k") - 1))
    hash_at = lambda d: F.get("label", d - F.col("lo") - 1)
    return pieces.select(
        F.when(F.col("k") == 0, F.col("up")).otherwise(hash_at(start)).alias("up"), start.alias("lo"),
        F.when(F.col("k") == F.size("ends") - 1, F.col("node")).otherwise(hash_at(F.col("depth"))).alias("node"), F.col("depth"),
        F.slice("label", start - F.col("lo") + 1, F.col("depth") - start).alias("label"), "leader",
    )


def trie(distinct: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes and owners of the compacted trie of distinct conversations (w, depth, hashes).

    Nodes: up (the hash of the node above), lo (its depth), node (hash), depth, label (hashes of the prefixes from lo + 1
    to depth) and leader (a conversation through all of the edge). Owners: w and `since`, the depth from which on w was
    the first to come.
    """
    spark = distinct.sparkSession
    most = distinct.agg(F.max("depth")).first()[0] or 0
    nodes = spark.createDataFrame([(None, 0, ROOT, 0, [], None)], "up binary, lo int, node binary, depth int, label array<binary>, leader long")
    coming, owners, batch = distinct.select("w", "depth", "hashes", F.lit(0).alias("lo")), None, 0
    while True:
        located = scratch.put(f"located-{batch}", locate(coming, nodes, most))
        cut = _cut(nodes, located)
        branching = located.where("leaves < depth").withColumn("next", _prefix(F.col("leaves") + 1))
        leaders = branching.groupBy("next").agg(F.max(F.struct("depth", (-F.col("w")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("w"))
        leaders = scratch.put(f"leaders-{batch}", leaders)
        leading = branching.join(leaders, "w")
        rest = F.slice("hashes", F.col("leaves") + 1, F.col("depth") - F.col("leaves"))
        new = leading.select(_prefix(F.col("leaves")).alias("up"), F.col("leaves").alias("lo"), _prefix(F.col("depth")).alias("node"), "depth", rest.alias("label"), F.col("w").alias("leader"))
        settled = located.where("leaves = depth").select("w", F.col("leaves").alias("since")).unionByName(leading.select("w", F.col("leaves").alias("since")))
        settled = scratch.put(f"owners-{batch}", settled)
        owners = settled if owners is None else owners.unionByName(settled)
        nodes = scratch.put(f"nodes-{batch}", cut.unionByName(new))
        coming = scratch.put(f"coming-{batch}", branching.join(leaders, "w", "left_anti").select("w", "depth", "hashes", F.col("leaves").alias("lo")))
        scratch.drop(f"located-{batch}", f"leaders-{batch}", *([f"nodes-{batch - 1}", f"coming-{batch - 1}"] if batch else []))
        if coming.isEmpty():
            return nodes, owners
        batch += 1


def _end_digests(all_paths: DataFrame) -> DataFrame:
    """node, ends_sha256: the SHA-256 of the numbers of the conversations that end there, ascending, comma-joined."""
    rows = all_paths.select("end", "conv_id").repartition("end").sortWithinPartitions("end", "conv_id")
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            nodes, hexes = [], []
            for end, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end == now:
                    state.update(b",%d" % conv)
                    continue
                if now is not None:
                    nodes.append(now)
                    hexes.append(state.hexdigest())
                now, state = end, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hexes, pa.string())], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], schema=schema)

    return map_arrow(rows, run, "node binary, ends_sha256 string")


def build(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All nodes of the trie of turns (conv_id, pos, role, text): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. `ids` (conv_id) names conversations without turns too."""
    scratch = Scratch(turns.sparkSession)
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("pos").cast("long"), F.lit(-(1 << 63))).alias("pos"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ids = (turns if ids is None else ids.where("conv_id is not null")).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    all_paths = scratch.put("paths", paths(turns, ids))
    copies = all_paths.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).drop("end")
    distinct = scratch.put("distinct-paths", all_paths.join(copies, "conv_id").withColumnRenamed("conv_id", "w"))
    nodes, owners = trie(distinct, scratch)
    nodes = scratch.numbered("trie", nodes, "number")

    # What each conversation adds to the nodes on its path.
    inner = nodes.where("up is not null").select(F.col("up").alias("end")).distinct().withColumn("inner", F.lit(True))
    passing = distinct.join(owners, "w").join(inner, "end", "left").withColumn("leaf", F.col("inner").isNull().cast("long"))
    after = F.get("upto", F.col("depth")) - F.get("upto", F.greatest(F.col("d") - 1, F.lit(0)))
    owned = F.get("upto", F.col("depth")) - F.get("upto", F.greatest(F.col("since"), F.col("d") - 1))
    branches = (F.col("since") <= F.col("d")) & (F.col("d") < F.col("depth"))
    steps = passing.select("*", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    adds = steps.select(F.when(F.col("d") > 0, F.get("hashes", F.col("d") - 1)).alias("node"), "w", "copies", "leaf", branches.cast("long").alias("child"), (F.col("copies") * after - owned).alias("saved"))
    sums = [F.min("w").alias("conv_id"), F.sum("copies").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved")]
    below = adds.where("node is not null").join(nodes.select("node", "number"), "node").groupBy("number").agg(*sums)
    root = adds.where("node is null").groupBy().agg(*sums).where("n_convs is not null")
    root = root.withColumn("node", F.lit(ROOT)).join(nodes.select("node", "number"), "node")
    stats = scratch.put("trie-sums", nodes.drop("label").join(below.unionByName(root.select(below.columns)), "number"))

    # Edges expand: the nodes inside have the members of the node below, and one child.
    above = stats.select(F.col("node").alias("up"), F.col("conv_id").alias("above"))
    edges = stats.join(above, "up", "left").join(_end_digests(all_paths), "node", "left").join(distinct.select(F.col("w").alias("leader"), "upto"), "leader", "left")
    spread = edges.select("*", F.explode(F.when(F.col("depth") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("lo") + 1, F.col("depth")))).alias("d"))
    last, long = F.col("d") == F.col("depth"), lambda c: F.col(c).cast("long")
    inside = F.when(last, 0).otherwise(F.get("upto", F.col("depth") - 1) - F.get("upto", F.col("d") - 1))
    return spread.select(
        "conv_id", long("d").alias("depth"), F.when(F.col("d") == F.col("lo") + 1, F.col("above")).when(F.col("d") > 0, F.col("conv_id")).alias("parent_conv_id"), long("n_convs").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), long("n_leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * inside).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
