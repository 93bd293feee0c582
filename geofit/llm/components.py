"""Connected components of links between integer ids, by alternating stars.

Each task first contracts its own links with a union-find, so that chains and large cliques shrink where they lie.
Then, until nothing changes, every node's neighbours are joined to the least of them (large star: the greater
neighbours; small star: the lesser). The least neighbour is a pre-aggregated minimum and the star is an equi-join
of links with it, which Spark splits where a node has many. Rounds are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import map_arrow, staged


def _contract(links: DataFrame) -> DataFrame:
    """Links of each task as (node, least node it reaches there)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        def flush() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    parent.setdefault(min(a, b), min(a, b))
            if len(parent) > 1_000_000:  # bounded memory: what is known so far goes out as links
                yield flush()
        yield flush()

    return map_arrow(links.select("a", "b"), run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Joins each node's greater (large) or lesser neighbours to the least neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of every node in links (a, b); pairs with a null or to itself say nothing."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = staged(_contract(ordered).distinct(), "links")
    while True:
        new = staged(_star(_star(now, True), False), "links")
        state = [tuple(x.agg(F.count("a"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()) for x in (now, new)]
        now = new
        if state[0] == state[1]:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
