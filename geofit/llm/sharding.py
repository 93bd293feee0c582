"""Extendible hashing of documents into shards below a byte limit, with DataFrame functions only.

A row's address is a bit string: 32 bits of a hash of its key, then 32 bits of a hash of its whole content, then
bits of its place in the scan, for rows that are the same throughout. The directory starts with one bucket. A
bucket over the limit is split on its next bit, and only such buckets are; those that fit stay as they are. A
bucket of one row cannot be split: a row larger than the limit has a shard of its own, marked oversize.

Sizes are summed once per address prefix of FINE_BITS before anything is split, so that a level of the
directory is a sum over at most 2^FINE_BITS counts and not over rows; deeper levels read only the rows of
buckets that are still too large. The directory holds a row per shard. The sums' prefixes look up their shards in
it, and the rows meet those in one equi-join, which Spark splits where one prefix holds many rows.

Null keys and null text are hashed as such; text of null weighs nothing. Repeated rows are kept and weigh each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import staged

SHARD_BYTES = 64 << 20
#: Depth to which sizes are summed at once: at most a million sums.
FINE_BITS = 20
_ADDRESS_BITS = 96


def _bits32(hexadecimal: Column) -> Column:
    return F.lpad(F.conv(F.substring(hexadecimal, 1, 8), 16, 2), 32, "0")


def addressed(docs: DataFrame, key: str = "doc_id", content: str = "text", carry: bool = False) -> DataFrame:
    """The key, the content's bytes, and the row's address."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    place = F.monotonically_increasing_id()
    return docs.select(
        F.col(key).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.concat(_bits32(F.md5(name)), _bits32(F.md5(F.concat_ws("|", name, text))), _bits32(F.md5(place.cast("string")))).alias("address"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []),
    )


def directory(rows: DataFrame, limit: int = SHARD_BYTES, fine_bits: int = FINE_BITS) -> tuple[DataFrame, DataFrame | None, int]:
    """prefix, depth, n_docs, shard_bytes, oversize: one row per bucket, whose prefixes cover all addresses once;
    the rows of buckets deeper than fine_bits, if any; and the greatest depth."""
    fine = staged(
        rows.groupBy(F.substring("address", 1, fine_bits).alias("place")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("shard_bytes")),
        "shard-sums",
    )
    done, open_, deep = [], None, None
    for depth in range(_ADDRESS_BITS + 1):
        if depth == fine_bits + 1:  # from here on the rows decide, of the buckets that are still too large
            parents = open_.select(F.col("prefix").alias("parent"))
            deep = staged(rows.join(parents, F.substring("address", 1, fine_bits) == F.col("parent"), "left_semi"), "shard-rows")
        level = fine if deep is None else deep.select(F.col("address").alias("place"), F.lit(1).alias("n_docs"), F.col("n_bytes").alias("shard_bytes"))
        if open_ is not None:
            level = level.join(open_.select(F.col("prefix").alias("parent")), F.substring("place", 1, depth - 1) == F.col("parent"), "left_semi")
        counts = level.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(F.sum("n_docs").alias("n_docs"), F.sum("shard_bytes").alias("shard_bytes"))
        counts = staged(counts.withColumn("depth", F.lit(depth).cast("long")), "shard-level")
        settled = (F.col("shard_bytes") <= limit) | (F.col("n_docs") == 1) | (F.col("depth") == _ADDRESS_BITS)
        done.append(counts.where(settled))
        open_ = counts.where(~settled)
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return staged(out.withColumn("oversize", F.col("shard_bytes") > limit), "shard-directory"), deep, depth


def _matched(places: DataFrame, column: str, known: DataFrame, depths: range) -> DataFrame:
    """Each place with the one bucket whose prefix it begins with."""
    tried = places.withColumn("prefix", F.explode(F.array(*[F.substring(column, 1, d) for d in depths])))
    return tried.join(known, "prefix")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", content: str = "text", fine_bits: int = FINE_BITS, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix, `*` for the whole), depth, shard_docs, shard_bytes, oversize: one row per
    row of docs; with carry also the row itself as the struct `doc`, so that no names clash."""
    rows = addressed(docs, key, content, carry)
    known, deep, depth = directory(rows, limit, fine_bits)
    places = rows.select(F.substring("address", 1, fine_bits).alias("fine")).distinct()
    shallow = _matched(places, "fine", known.where(F.col("depth") <= fine_bits), range(min(depth, fine_bits) + 1))
    out = rows.withColumn("fine", F.substring("address", 1, fine_bits)).join(shallow, "fine").drop("fine")
    if deep is not None:
        own = _matched(deep, "address", known.where(F.col("depth") > fine_bits), range(fine_bits + 1, depth + 1))
        out = out.unionByName(own)
    names = ["doc_id", "n_bytes", F.when(F.col("prefix") == "", "*").otherwise(F.col("prefix")).alias("shard"), "depth", F.col("n_docs").alias("shard_docs"), "shard_bytes", "oversize"]
    return out.select(*names, *(["doc"] if carry else []))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """The documents in a folder for each shard."""
    shard(docs, limit, carry=True).select("doc", "shard").write.partitionBy("shard").parquet(path)
