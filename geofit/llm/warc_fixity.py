"""Merkle fixity audit of WARC replicas.

Each record is hashed where it lies; only (file, offset, hash) moves. A file's leaves are ranges of LEAF_BYTES of
offsets, whose hash covers the offsets and hashes of the records that begin there, in order; a node covers the
hashes of up to FAN_OUT ranges below it, up to the file's top ranges. Two replicas are compared at the top, and only
the children of nodes that differ are read on the next level, down to the records of damaged leaves.

A node has at most FAN_OUT children and a leaf as many records as begin in its range, so no group grows with a file.
Null content hashes as empty; rows without a file or offset are not records and are left out. Records repeated at one
offset are compared as a sorted list of hashes. An empty replica lacks everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import staged

LEAF_BYTES = 64 << 10
FAN_OUT = 16
#: Levels above the leaves: top ranges hold 4 GiB.
LEVELS = 4


def record_text(url: Column, body: Column) -> Column:
    """A response record as it stands in a WARC file."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def hashed(records: DataFrame) -> DataFrame:
    """file, offset, hash of records (file, offset, content); repeats at an offset as one."""
    one = records.dropna(subset=["file", "offset"]).select("file", F.col("offset").cast("long").alias("offset"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    return one.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Nodes (file, place, hash) by level, the leaves first; each level is a table in the shared folder."""
    level = records.withColumn("place", F.floor(F.col("offset") / LEAF_BYTES)).withColumn("at", F.col("offset"))
    out = []
    for k in range(LEVELS + 1):
        if k:
            level = out[-1].withColumn("at", F.col("place")).withColumn("place", F.floor(F.col("place") / FAN_OUT))
        nodes = level.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("below"))
        covered = F.array_join(F.transform("below", lambda x: F.concat(x["at"].cast("string"), F.lit("="), x["hash"])), ";")
        out.append(staged(nodes.select("file", "place", F.sha2(covered, 256).alias("hash")), f"merkle-{k}"))
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), keys, "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(records_a: DataFrame, records_b: DataFrame) -> DataFrame:
    """file, offset, status (corrupt, missing, extra: in b against a), hash_a, hash_b of every record that differs."""
    a, b = staged(hashed(records_a), "records-a"), staged(hashed(records_b), "records-b")
    tree_a, tree_b = tree(a), tree(b)
    bad = _differing(tree_a[-1], tree_b[-1], ["file", "place"]).select("file", "place")
    for k in range(LEVELS - 1, -1, -1):
        parents = staged(bad, "damaged").select(F.col("file").alias("in_file"), F.col("place").alias("parent"))
        under = (F.col("file") == F.col("in_file")) & (F.floor(F.col("place") / FAN_OUT) == F.col("parent"))
        bad = _differing(tree_a[k].join(parents, under, "left_semi"), tree_b[k].join(parents, under, "left_semi"), ["file", "place"]).select("file", "place")
    leaves = staged(bad, "damaged").select(F.col("file").alias("in_file"), F.col("place").alias("leaf"))
    inside = (F.col("file") == F.col("in_file")) & (F.floor(F.col("offset") / LEAF_BYTES) == F.col("leaf"))
    found = _differing(a.join(leaves, inside, "left_semi"), b.join(leaves, inside, "left_semi"), ["file", "offset"])
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return found.select("file", "offset", status.alias("status"), "hash_a", "hash_b")
