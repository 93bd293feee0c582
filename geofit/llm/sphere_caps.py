"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction of the unit sphere, and its cap holds the vectors whose inner product with it exceeds a
height. Directions come from a structured random product code: the space, randomly rotated, is cut into BLOCKS
blocks with a few random unit words each, and every combination of words is a direction. A vector is list-decoded
to all directions it exceeds block by block, dropping combinations that the best remaining words cannot save. Pairs
of vectors in one cap are verified by their cosine in double precision; nothing below the threshold is linked.

The number of directions is in proportion to the number of vectors, so a cap holds a few vectors at any size; the
height is what makes a vector exceed FILTERS of them on average, from the distribution of one coordinate of a random
unit vector. One code leaves some vectors with few directions, so CODES independent ones are used: a pair at the
threshold of 0.95 shares no cap of one code with a chance of about 0.2, of all with one of about 1 in 10,000, and
closer pairs less often (the tests measure it). Equal vectors are one class from the start. A cap that holds many
classes - a group of near copies - is cut into blocks of BLOCK_ROWS, and each pair of blocks is work of its own.

In caps, unit vectors travel as half-precision numbers. Their inner product is off by HALF_ERROR at most, so it
decides a pair unless it falls within that of the threshold; those few pairs are looked up and decided in doubles.

Null vectors, those of a null or non-finite component, of no components or of length zero link with nothing.
Vectors of different dimensions do not link. Each row is a vector, also where its vec_id repeats; a null vec_id is
compared as any, and a component is named by its least vec_id. Other columns are not carried.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import map_arrow, staged
from geofit.llm.components import components

CODES = 6
BLOCKS = 2
#: Shorter vectors are rotated into a space of this dimension, where random directions are fine enough.
LEAST_DIM = 16
#: Directions of a code that a vector exceeds, on average.
FILTERS = 16
#: Directions of a code for each vector.
DIRECTIONS = 8
BLOCK_ROWS = 512
#: Crowded caps are broadcast up to this number, and joined beyond it.
SMALL_CAPS = 1_000_000
#: Twice the relative rounding of half precision, and some more.
HALF_ERROR = 1.1e-3


def cap_height(dim: int, share: float) -> float:
    """The inner product with a fixed unit vector that this share of random unit vectors exceeds."""
    if share >= 1:
        return -2.0  # all exceed it
    angle = np.linspace(0, np.pi, 400_001)
    within = np.cumsum(np.sin(angle) ** (dim - 2))  # the share of the sphere within this angle of the vector
    return float(np.cos(angle[np.searchsorted(within / within[-1], share)]))


class ProductCode:
    def __init__(self, dim: int, vectors: int, seed: int = 0):
        rng = np.random.default_rng([seed, dim])
        dim, own = max(dim, LEAST_DIM), dim
        m = BLOCKS
        words = max(2, int(np.ceil((DIRECTIONS * max(vectors, FILTERS)) ** (1 / m))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:own]
        self.blocks = np.array_split(np.arange(dim), m)
        self.words = []
        for block in self.blocks:
            w = rng.standard_normal((words, len(block)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(m))
        self.height = cap_height(dim, min(1.0, FILTERS / words**m))

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that each unit vector exceeds."""
        turned = units @ self.rotation
        scores = [turned[:, b] @ w.T for b, w in zip(self.blocks, self.words)]
        best = [s.max(axis=1) for s in scores]
        row, code, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for i, s in enumerate(scores):
            reach = total[:, None] + s[row]
            rest = sum(best[i + 1:]) if i + 1 < len(scores) else np.zeros(len(units))
            at, word = np.nonzero(reach + rest[row][:, None] > self.height)
            row, code, total = row[at], code[at] * len(self.words[i]) + word, reach[at, word]
        return row, code


@functools.cache
def product_codes(dim: int, vectors: int) -> list[ProductCode]:
    return [ProductCode(dim, vectors, seed) for seed in range(CODES)]


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(classes: DataFrame, vectors: int, with_units: bool) -> DataFrame:
    """cap, and rep and unit (half precision) when asked for: a row for each class and direction it exceeds."""
    schema = pa.schema([("cap", pa.int64())] + ([("rep", pa.int64()), ("unit", pa.binary())] if with_units else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), 256):
                    own = rows[lo: lo + 256]
                    units = _units(_matrix(batch.column(1), own, dim))
                    halves = pa.array([h.tobytes() for h in units.astype("<f2")], pa.binary())
                    for k, code in enumerate(product_codes(int(dim), vectors)):
                        at, cap = code.decode(units)
                        out = [pa.array((cap * CODES + k) * 4096 + int(dim) % 4096)]
                        if with_units:
                            out += [batch.column(0).take(pa.array(own[at])), halves.take(pa.array(at))]
                        yield pa.RecordBatch.from_arrays(out, schema=schema)

    return map_arrow(classes.select("rep", "embedding"), run, "cap long" + (", rep long, unit binary" if with_units else ""))


def _verified(rows: DataFrame, least_cosine: float) -> DataFrame:
    """a, b, sure of pairs that link or might, among rows of one (cap, i, j): block i with block j, or within i."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def pairs(reps: np.ndarray, blocks: np.ndarray, units: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        left = np.flatnonzero(blocks == blocks.min())
        right = left if blocks.min() == blocks.max() else np.flatnonzero(blocks == blocks.max())
        for lo in range(0, len(left), BLOCK_ROWS):
            for start in range(0, len(right), BLOCK_ROWS):
                p, q = left[lo: lo + BLOCK_ROWS], right[start: start + BLOCK_ROWS]
                cosine = units[p] @ units[q].T
                x, y = np.nonzero(cosine >= least_cosine - HALF_ERROR)
                a, b = reps[p[x]], reps[q[y]]
                keep = (a > b) if right is left else (a != b)
                yield np.maximum(a, b)[keep], np.minimum(a, b)[keep], (cosine[x, y] >= least_cosine + HALF_ERROR)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            caps = np.stack([whole.column(c).to_numpy() for c in ("cap", "i", "j")])
            edges = np.flatnonzero((caps[:, 1:] != caps[:, :-1]).any(axis=0)) + 1
            done = int(edges[-1]) if len(edges) else 0
            held = whole.slice(done)
            yield from groups(whole.slice(0, done), edges)
        if held is not None:
            yield from groups(held, np.array([held.num_rows]))

    def groups(part: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not part.num_rows:
            return
        part = part.combine_chunks()
        reps, blocks = part.column("rep").to_numpy(), part.column("block").to_numpy()
        column = part.column("unit").combine_chunks()
        found = []
        lo = 0
        for hi in edges.tolist():
            if hi - lo > 1:
                units = [np.frombuffer(v.as_py(), "<f2").astype(np.float64) for v in column.slice(lo, hi - lo)]
                lengths = np.array([len(u) for u in units])
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    found += pairs(reps[lo + at], blocks[lo + at], np.stack([units[i] for i in at]))
            lo = hi
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema)

    return map_arrow(rows, run, "a long, b long, sure boolean")


def _decided(pairs: DataFrame, classes: DataFrame, least_cosine: float) -> DataFrame:
    """Those of the pairs (a, b) whose cosine in double precision reaches the threshold."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    biggest = F.array_max(F.transform(doubles, F.abs))
    scaled = classes.select("rep", F.transform(doubles, lambda x: x / biggest).alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = pairs.join(scaled.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(scaled.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.where(dot / (norm(F.col("va")) * norm(F.col("vb"))) >= least_cosine).select("a", "b")


def link(vectors: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = staged(good.groupBy("embedding").agg(F.min("rid").alias("rep"), F.count("rid").alias("copies")), "vectors")
    members = staged(good.join(classes.select("embedding", "rep"), "embedding").select("rid", "vec_id", "rep"), "members")

    n = classes.count()
    crowded = staged(_decoded(classes, n, False).groupBy("cap").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK_ROWS), "crowded-caps")
    crowded = F.broadcast(crowded) if crowded.count() <= SMALL_CAPS else crowded
    decoded = _decoded(classes, n, True).join(crowded, "cap", "left").withColumn("n", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK_ROWS))
    blocked = decoded.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = blocked.select("cap", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "unit")
    verified = _verified(placed.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j"), least_cosine)
    pairs = staged(verified.groupBy("a", "b").agg(F.max("sure").alias("sure")), "cap-pairs")
    links = staged(pairs.where("sure").select("a", "b").unionByName(_decided(pairs.where("not sure").select("a", "b"), classes, least_cosine)), "cap-links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("rep").alias("b"), "copies")
    linked = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "rep")
    named = members.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep")).drop("component")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    own = classes.select("rep", "copies").join(linked, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    found = named.join(least, "root").join(own, "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
