"""Merkle manifest of a dataset: one root over all documents, and for each document the proof that leads there.

A leaf is the hash of a document's fields. Per source, leaves ascend by doc_id, and every FAN consecutive nodes become
the hash of their concatenation, level by level, until one is left: the source's root. The sources' roots, ordered by
source, go the same way to the root of the dataset.

On each level a window over blocks of whole runs has lag and lead columns of the fixed offsets 1 to FAN - 1. A node's
slot (its place in its run) says which lags are its siblings, slot and run length which leads are; the others are
masked. Siblings on the left and right, concatenated, are the node's part of every proof below it, and the run's first
child hashes itself with its leads: that is the parent.

No window holds a source. Rows are cut into ranges of (source, doc_id), written once with their order, and numbered by
what the ranges before hold; blocks have BLOCK nodes. From the top down each node of the second level gets the path
above it, once for the BLOCK leaves below it, and the leaves meet it where their window has put them already.

Null fields hash as `-`. A null doc_id sorts first, rows of one doc_id by their leaves; repeated rows are leaves each.
A null source is a source of its own, before all others. A table without rows has no root and gives no rows. Texts of
any length are hashed where they are read and are not moved. Only the source column is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofit.llm.common import Scratch

FAN = 16
#: Leaves of one window partition: two levels of whole runs.
BLOCK = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs concatenated; digests go in as hex text."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """A document's leaf hash, of another text when one is given."""
    return digest(*[field(docs[c] if c != "text" or text is None else text) for c in FIELDS])


def _placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (grp, ...) with i (place in the group by `order`, from 0) and n (rows of the group)."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    kept = scratch.put(name, ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    pieces = kept.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("held").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("grp", "part", (F.col("first") - before).alias("zero"), F.sum("held").over(w).alias("n"))
    return kept.join(pieces, ["grp", "part"]).withColumn("i", F.col("seq") - F.col("zero")).drop("part", "seq", "zero")


def _siblings(nodes: DataFrame) -> DataFrame:
    """nodes (grp, i, n, node, ...) with block, l and r: the digests of the run's others on either side, concatenated."""
    nodes = nodes.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))
    w = Window.partitionBy("grp", "block").orderBy("i")
    slot = F.col("i") % FAN
    run = F.least(F.lit(FAN), F.col("n") - (F.col("i") - slot))
    near = [F.lag("node", k).over(w).alias(f"lag{k}") for k in range(1, FAN)] + [F.lead("node", k).over(w).alias(f"lead{k}") for k in range(1, FAN)]
    wide = nodes.select("*", *near)
    left = F.concat(*[F.when(slot >= k, F.col(f"lag{k}")).otherwise("") for k in range(FAN - 1, 0, -1)])
    right = F.concat(*[F.when(slot + k < run, F.col(f"lead{k}")).otherwise("") for k in range(1, FAN)])
    return wide.select(*nodes.columns, left.alias("l"), right.alias("r"))


def _parents(level: DataFrame) -> DataFrame:
    """The nodes above a level (grp, i, n, node, l, r): each run's first child hashes it."""
    first = level.where(F.col("i") % FAN == 0)
    up = (F.col("i") / FAN).cast("long")
    return first.select("grp", up.alias("i"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest(F.col("node"), F.col("r")).alias("node"))


def grow(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Tops and paths of the trees over nodes (grp, i, n, node).

    Tops: grp, top. Paths: grp, block, near (the siblings l and r of the first level above the leaves, by slot; null
    where the group ends below it) and far (those of all levels above that), one row for each block of BLOCK leaves.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, current = [], nodes
    tops = nodes.where("n = 1").select("grp", F.col("node").alias("top"))
    while most > 1:
        level = _siblings(current.where("n > 1"))
        if levels:
            level = scratch.put(f"{name}-{len(levels)}", level)
        levels.append(level)
        current = scratch.put(f"{name}-above-{len(levels)}", _parents(level))
        tops = tops.unionByName(current.where("n = 1").select("grp", F.col("node").alias("top")))
        most = -(-most // FAN)
    # From the top down: a node's path is its own siblings and its parent's path.
    path = None
    for level in reversed(levels[2:]):
        own = F.array(F.struct("l", "r"))
        rows = level.select("grp", "i", F.floor(F.col("i") / FAN).cast("long").alias("parent"), own.alias("own"))
        if path is None:
            path = rows.select("grp", "i", F.col("own").alias("path"))
        else:
            above = path.select("grp", F.col("i").alias("parent"), F.col("path").alias("above"))
            path = rows.join(above, ["grp", "parent"], "left").select("grp", "i", F.concat("own", F.coalesce("above", F.array().cast(_PATH))).alias("path"))
    blocks = nodes.where(F.col("i") % BLOCK == 0).select("grp", (F.col("i") / BLOCK).cast("long").alias("block"))
    if len(levels) > 1:
        near = levels[1].groupBy("grp", F.floor(F.col("i") / FAN).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "l", "r"))).alias("near"))
        blocks = blocks.join(near, ["grp", "block"], "left").withColumn("near", F.transform("near", lambda x: F.struct(x.l.alias("l"), x.r.alias("r"))))
    else:
        blocks = blocks.withColumn("near", F.lit(None).cast(_PATH))
    if path is not None:
        blocks = blocks.join(path.select("grp", F.col("i").alias("block"), F.col("path").alias("far")), ["grp", "block"], "left")
    else:
        blocks = blocks.withColumn("far", F.lit(None).cast(_PATH))
    return tops, blocks


def _with_paths(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes (grp, i, n, node, ...) with path: the siblings of every level from the node to the top of its group."""
    own = F.when(F.col("n") > 1, F.array(F.struct("l", "r"))).otherwise(F.array().cast(_PATH))
    at = F.get("near", ((F.col("i") / FAN).cast("long") % FAN).cast("int"))
    near = F.when(F.col("near").isNotNull(), F.array(at)).otherwise(F.array().cast(_PATH))
    rows = _siblings(nodes).join(blocks, ["grp", "block"])
    return rows.withColumn("path", F.concat(own, near, F.coalesce("far", F.array().cast(_PATH)))).drop("near", "far", "l", "r", "block")


def manifest(docs: DataFrame, tampered_text: Column, tampered: Column) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (siblings l and r of every level), claimed (the leaf of the text as it
    is found: `tampered_text` where `tampered` holds) for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    grp = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    own = leaf(docs)
    claimed = F.when(tampered, leaf(docs, tampered_text)).otherwise(own)
    rows = docs.select(docs["doc_id"], docs["source"], grp.alias("grp"), own.alias("node"), claimed.alias("claimed"))
    leaves = scratch.put("manifest-leaves", _placed(rows, ["doc_id", "node"], scratch, "manifest-order"))
    scratch.drop("manifest-order")
    tops, blocks = grow(leaves.select("grp", "i", "n", "node"), scratch, "manifest")

    roots = tops.select(F.lit("").alias("grp"), F.col("grp").alias("source_grp"), F.col("top").alias("node"))
    roots = scratch.put("manifest-roots", _placed(roots, ["source_grp"], scratch, "manifest-sources"))
    scratch.drop("manifest-sources")
    root, root_blocks = grow(roots.select("grp", "i", "n", "node"), scratch, "manifest-top")
    above = _with_paths(roots, root_blocks).join(root, "grp")
    above = above.select(F.col("source_grp").alias("grp"), F.col("node").alias("subroot"), F.col("path").alias("above"), F.col("top").alias("root"))

    # What all leaves of a block share meets its source's path here, once a block.
    blocks = scratch.put("manifest-blocks", blocks.join(above, "grp"))
    found = _with_paths(leaves, blocks)
    return found.select("doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("proof"), "claimed")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda acc, x: digest(x.l, acc, x.r))


def audit(docs: DataFrame, tampered_text: Column, tampered: Column) -> DataFrame:
    """The manifest with a digest of each proof, the root folded from the document as found, and whether it is the root."""
    m = manifest(docs, tampered_text, tampered)
    out = m.select(
        "doc_id", "source", "leaf", "subroot", "root",
        F.sha2(F.array_join(F.transform("proof", lambda x: F.concat(x.l, x.r)), ""), 256).alias("proof_sha256"),
        fold(F.col("claimed"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
