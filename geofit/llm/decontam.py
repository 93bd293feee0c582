"""Benchmark decontamination with one Aho-Corasick automaton.

Test texts (questions and answers alike) are normalised: A-Z lower-cased, everything but letters, digits and
non-ASCII bytes a separator, words joined by one space. Every run of ten words of an item is a pattern; an item
of fewer words is one pattern. All patterns go into one automaton, and each document's normalised text is read
once through it. A match's place among the normalised words leads back to the original characters.

The patterns are broadcast. They come from the benchmark table, whose size is checked first; a larger benchmark
is cut into blocks below the bound, and the documents are read once for each block.

Null and empty texts have no words and hit nothing. Repeated items keep their own ids; repeated documents are
judged each. An item with null id counts like any other, so that its words hit, but it adds no id to `hits`. An empty
benchmark leaves every document clean. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import Scratch, blocks, buffers, map_arrow, run_bounds, staged

WINDOW_WORDS = 10
#: Bytes of benchmark text in one automaton; some 100 times as much memory in each task.
AUTOMATON_BYTES = 2 << 20

#: Byte -> lower-cased byte, or a space for a separator.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i: i + size]) for i in range(max(1, len(words) - size + 1))]


class Automaton:
    """Windows of the items; finds all of them in normalised text."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW_WORDS):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(words_of(text), size):
                owners.setdefault(w, set()).update(() if item is None else (item,))
        self.owners = [sorted(v) for v in owners.values()]
        self.machine = ahocorasick.Automaton()
        for i, w in enumerate(owners):  # a space on either side keeps matches on whole words
            self.machine.add_word(" " + b" ".join(w).decode("latin-1") + " ", (i, len(w)))
        self.empty = not owners
        if not self.empty:
            self.machine.make_automaton()

    def ends(self, text: str | None) -> Iterator[int]:
        words = words_of(text)
        return (end for end, _ in self.machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1"))) if words else iter(())

    def find(self, normal: bytes) -> list[tuple[int, int, int]]:
        """(end of the match in normalised bytes, words, window) for each occurrence."""
        return [(end, n, i) for end, (i, n) in self.machine.iter(normal.decode("latin-1"))]


def _item_blocks(benchmark: DataFrame, automaton_bytes: int) -> list[DataFrame]:
    """The items (item_id, text) in blocks of about automaton_bytes of text at most; the sizes are summed in Spark, and a
    block is collected when it is used."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_blocks = -(-total * 2 // automaton_bytes) if total > automaton_bytes else 1
    return [items] if n_blocks == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) for k in range(n_blocks)]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, hits (array of item ids), n_hit, spans (array of [from, to) in characters of the original
    text: the maximal runs of hit words, from the first's start to the last's end) and row (a number of the row)."""
    item_blocks = _item_blocks(benchmark, automaton_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(item_blocks) == 1:
        return _scan(docs.withColumn("row", F.monotonically_increasing_id()), [tuple(r) for r in item_blocks[0].collect()], size).drop("word_runs")
    scratch = Scratch(docs.sparkSession)
    docs = scratch.numbered("documents", docs, "row")  # read once for each block: a row keeps its number
    parts = [scratch.put(f"scan-{k}", _scan(docs, [tuple(r) for r in own.collect()], size)) for k, own in enumerate(item_blocks)]
    scratch.drop("documents")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # Rows of a document in each block: the words hit are united, the items put together.
    merged = out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.flatten(F.collect_list("word_runs"))).alias("word_runs"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    united = F.aggregate(
        "word_runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, r: F.struct((a.n + F.greatest(F.lit(0), r[1] - F.greatest(r[0], a.end))).alias("n"), F.greatest(a.end, r[1]).alias("end")),
    )
    return merged.select("doc_id", "n_words", "hits", united.n.alias("n_hit"), F.array_sort("spans").alias("spans"), "row")


def _scan(docs: DataFrame, items: list[tuple[str | None, str | None]], size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.string())), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))]
    fields += [("row", pa.int64()), ("word_runs", pa.list_(pa.list_(pa.int64())))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(shared.value, size)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = batch.column(2).to_pylist()
            data, offsets = buffers(batch.column(1))
            for lo, hi in blocks(offsets):
                out: dict[str, list] = {name: [] for name in schema.names}
                for k in range(lo, hi):
                    original = data[offsets[k]: offsets[k + 1]]
                    words = original.tobytes().translate(_NORMAL).split()
                    found = [] if machine.empty or not words else machine.find(b" " + b" ".join(words) + b" ")
                    hits, runs, spans = _place(found, words, original, machine) if found else ([], [], [])
                    values = [ids[k], len(words), hits, sum(b - a for a, b in runs), spans, rows[k], runs]
                    for name, v in zip(schema.names, values):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    ddl = "doc_id long, n_words long, hits array<string>, n_hit long, spans array<array<long>>, row long, word_runs array<array<long>>"
    return map_arrow(docs, run, ddl)


def _place(found: list[tuple[int, int, int]], words: list[bytes], original: np.ndarray, machine: Automaton) -> tuple[list[str], list[list[int]], list[list[int]]]:
    """Items hit, runs of hit words, and their places in characters of the original."""
    ends = np.cumsum([len(w) + 1 for w in words])  # each word's end in the normalised text, after the first space
    last = np.searchsorted(ends, [e for e, _, _ in found]) + 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.array([n for _, n, _ in found]), 1)
    np.add.at(change, last, -1)
    hit = np.cumsum(change)[:-1] > 0
    starts, stops = run_bounds(hit, np.zeros(0, np.int64))
    is_word = np.frombuffer(_NORMAL, np.uint8)[original] != 32
    begin, end = run_bounds(is_word, np.zeros(0, np.int64))
    chars = np.concatenate([[0], np.cumsum((original & 0xC0) != 0x80)])  # characters before each byte
    spans = [[int(chars[begin[a]]), int(chars[end[b - 1]])] for a, b in zip(starts, stops)]
    items = sorted({o for _, _, i in found for o in machine.owners[i]})
    return items, [[int(a), int(b)] for a, b in zip(starts, stops)], spans


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan, and the spans."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("hits").cast("long").alias("n_items"), F.sha2(F.array_join("hits", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs: documents go through the automaton whole and are kept
    or not, so no row is looked up again."""
    scratch = Scratch(docs.sparkSession)
    for k, own in enumerate(item_blocks := _item_blocks(benchmark, automaton_bytes)):
        docs = _without(docs, [tuple(r) for r in own.collect()], size)
        if k + 1 < len(item_blocks):
            docs = scratch.put(f"clean-{k}", docs)
            if k:
                scratch.drop(f"clean-{k - 1}")
    return docs


def _without(docs: DataFrame, items: list[tuple[str | None, str | None]], size: int) -> DataFrame:
    shared, at = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(shared.value, size)
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch if machine.empty else batch.filter(pa.array([not any(True for _ in machine.ends(t.as_py())) for t in texts]))

    return map_arrow(docs, run, docs.schema)
