"""Exact repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

Every byte covered by a string of `length` bytes that starts at two places at least is found, whatever the places.
A suffix matters up to `length` bytes: a window. Sorting all windows as they are would move each text hundreds of
times, so the sort is told first what cannot repeat, and what repeats alike:

1. A window's anchor is the least hash among its grams (leftmost if tied), a function of its bytes. The windows of one
   anchor in a row, with their text, are a span. A window can only equal one whose anchor has the same gram; spans
   whose gram occurs once leave. (A prefix's fingerprint decides which strings need sorting at all.)
2. Each task sorts its spans as strings and sends the sorted run front-coded: the length shared with the string
   before, and the rest. A task that receives runs merges them with a loser tree over those lengths. Equal spans,
   neighbours with nothing but common prefix, repeat with all their windows and are one string from here on.
3. Where a gram has several different spans, each is cut into parts by the windows' distance to the anchor, which is
   the same for equal windows. All windows of a part hold its core; parts whose core occurs once leave, too. The
   windows of the rest are sorted: a run holds each part's text once, and the sorted suffixes as references with the
   lengths they share. The merge finds the windows that repeat.
4. What repeats is looked up for every document that holds the span, as byte ranges, which are united and cut out.

Runs go to buckets by the span's hash (2) or the core (3), of bounded mean size. Windows of a core of more than HOT
parts are dealt by the window's own hash. Within a run equal strings (2) and equal windows of a hot core (3) are sent
once, so that what a third of all documents hold reaches its bucket once a run. Nothing is broadcast by hint.

Null text is empty; texts shorter than `length` hold nothing to find; repeated rows are documents of their own, and
a null doc_id is kept. Other columns are not carried by `cut`. Rows are numbered once, in a table, so that any frame
may be given. Texts are whole rows of a task, however long; spans are found in blocks of SPAN_BLOCK bytes or one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from geofit.llm.common import Scratch, SpanHash, blocks, buffers, map_arrow
from geofit.llm.loser_tree import common_prefix, merge, prefixes

MIN_BYTES = 400
HOT = 1000
#: Windows' distances to the anchor in one part of a span.
NEAR = 32
SPANS_A_BUCKET = 500
PARTS_A_BUCKET = 2000
#: Bytes of text whose spans are found at a time: its arrays of 64-bit numbers stay in the processor's cache.
SPAN_BLOCK = 1 << 15
#: Spans of a task whose grams are compared before they are dealt.
SPANS_AT_ONCE = 100_000
#: Bytes of spans that a task sorts into one set of runs.
RUN_BYTES = 8 << 20
#: A word: what stands between white space; Han characters and kana, written without it, are a word each.
_SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{_SINGLE}]|[^\\s{_SINGLE}]+")
#: Passages of words in one batch of a task.
PASSAGES_A_BATCH = 50_000


def _least(h: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of each w neighbours, from those of 2, 4, 8, ... neighbours."""
    n, known = len(h) - w + 1, 1
    while 2 * known <= w:
        h = pick(h[:-known], h[known:])
        known *= 2
    return pick(h[:n], h[w - known: w - known + n])


def _gram(length: int) -> int:
    """Bytes of the grams among which windows of this length have their anchor."""
    return max(1, min(64, length // 4))


def spans(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Document, first and last window start, anchor (positions in the block), gram and hash of each span."""
    gram = _gram(length)
    w = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = SpanHash(data)
    grams = hashes.rolling(gram)
    least = _least(grams, w, np.minimum)
    inside = np.ones(len(least), bool)
    for end in offsets[1:-1]:  # windows that would cross documents
        inside[max(0, end - length + 1): end] = False
    starts = np.flatnonzero(inside)
    wanted = least[starts]
    # Places that are some window's least gram, and for each window the first of them that is its own.
    reach = _least(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    is_chosen = grams == reach
    chosen = np.flatnonzero(is_chosen)
    k = (np.cumsum(is_chosen) - is_chosen)[starts]
    open_ = np.arange(len(k))
    while len(open_ := open_[grams[chosen[k[open_]]] != wanted[open_]]):
        k[open_] += 1
    anchor = chosen[k]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else none
    first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])] if len(starts) else none
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, first, last, anchor[new], wanted[new], hashes(first, last + length)


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """gram, span, rid, at, last (first and last window start in the document), before (bytes of the anchor from `at`),
    and how to tell whether the gram occurs again: `twice` (it does among the same SPANS_AT_ONCE of a task) and `spread`
    (0 for the first of them, which stands for the gram there, else its own)."""
    names = ("gram", "span", "rid", "at", "last", "before", "spread")
    schema = pa.schema([*((name, pa.int64()) for name in names), ("twice", pa.bool_())])

    def told(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, span, rid, at, last, before = (np.concatenate(x) for x in zip(*held))
        _, first, which, n = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        spread = rid + 1
        spread[first] = 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, span, rid, at, last, before, spread, n[which] > 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for lo, hi in blocks(offsets, SPAN_BLOCK):
                base = offsets[lo: hi + 1] - offsets[lo]
                doc, first, last, anchor, gram, span = spans(data[offsets[lo]: offsets[hi]], base, length)
                held.append((gram.view(np.int64), span.view(np.int64), rids[lo + doc], first - base[doc], last - base[doc], anchor - first))
                size += len(gram)
                if size >= SPANS_AT_ONCE:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return map_arrow(texts.select("rid", "text"), run, "gram long, span long, rid long, at long, last long, before long, spread long, twice boolean")


def _repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """gram, span, rid, at, last, before of the spans whose gram occurs more than once. They are dealt once, as they are
    found; a frequent gram has no more rows in one task than there are portions of SPANS_AT_ONCE."""
    n = F.count("rid").over(Window.partitionBy("gram", "spread"))
    return _spans(texts, length).withColumn("n", n).where("twice or n > 1").select("gram", "span", "rid", "at", "last", "before")


def _span_texts(texts: DataFrame, several: DataFrame, length: int) -> DataFrame:
    """gram, span, before, text of the spans in `several`: each text meets the list of its own spans."""
    own = several.groupBy("rid").agg(F.collect_list(F.struct("gram", "span", "before", "at", "last")).alias("own"))
    schema = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("before", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                gram, span, before, at, last = (held.values.field(k) for k in range(5))
                cut_ = [raw[a: b + length] for a, b in zip(at.to_pylist(), last.to_pylist())]
                yield pa.RecordBatch.from_arrays([gram, span, before, pa.array(cut_, pa.binary())], schema=schema)

    return map_arrow(texts.join(own, "rid").select("text", "own"), run, "gram long, span long, before long, text binary")


def _runs(rows: DataFrame, schema: pa.Schema, ddl: str, make: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """Rows of a task, in portions of RUN_BYTES of text, to what `make` gives for a portion."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["text"])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_pylist(list(make(held)), schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(make(held)), schema=schema)

    return map_arrow(rows, run, ddl)


def _merged(runs: DataFrame, schema: pa.Schema, ddl: str, make: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """Runs of each bucket, which lie together, to what `make` gives for a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for i in range(batch.num_rows):  # one row's lists at a time, as a batch of runs is large
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if held and held[0]["bucket"] != row["bucket"]:
                    out += make(held)
                    held = []
                    if len(out) > 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                held.append(row)
        if held:
            out += make(held)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(runs.repartition("bucket").sortWithinPartitions("bucket"), run, ddl)


_RUN = pa.schema([("bucket", pa.int64()), ("grams", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("before", pa.list_(pa.int32())), ("copies", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("rests", pa.binary())])
_RUN_DDL = "bucket long, grams array<long>, ids array<long>, before array<int>, copies array<int>, shared array<int>, sizes array<int>, rests binary"
_STRING = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("before", pa.int64()), ("copies", pa.int64()), ("text", pa.binary())])
_REFER = pa.schema([("bucket", pa.int64()), ("grams", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("base", pa.list_(pa.int32())), ("texts", pa.list_(pa.binary())), ("owner", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("known", pa.list_(pa.list_(pa.int64())))])
_REFER_DDL = "bucket long, grams array<long>, ids array<long>, copies array<long>, base array<int>, texts array<binary>, owner array<int>, start array<int>, shared array<int>, known array<array<long>>"
_REPEAT = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def distinct_spans(rows: DataFrame, buckets: int) -> DataFrame:
    """gram, span, before, copies, text: each different string once, by front-coded runs and loser trees."""
    def runs(held: list[dict]) -> Iterator[dict]:
        by: dict[int, list[dict]] = {}
        for r in held:
            by.setdefault(r["span"] % buckets, []).append(r)
        for bucket, own in by.items():
            own.sort(key=lambda r: r["text"])
            shared = prefixes([r["text"] for r in own])
            kept: list[dict] = []
            for r, n in zip(own, shared):
                if kept and n == len(r["text"]) == len(kept[-1]["text"]):
                    kept[-1]["copies"] += 1
                else:
                    kept.append({**r, "copies": 1, "shared": n})
            yield {
                "bucket": bucket, "grams": [r["gram"] for r in kept], "ids": [r["span"] for r in kept], "before": [r["before"] for r in kept], "copies": [r["copies"] for r in kept],
                "shared": [r["shared"] for r in kept], "sizes": [len(r["text"]) for r in kept], "rests": b"".join(r["text"][r["shared"]:] for r in kept),
            }

    def strings(run: dict) -> Iterator[tuple[bytes, int, object]]:
        text, at = b"", 0
        for i, (n, size) in enumerate(zip(run["shared"], run["sizes"])):
            text = text[:n] + run["rests"][at: at + size - n]
            at += size - n
            yield text, n, (run["grams"][i], run["ids"][i], run["before"][i], run["copies"][i])

    def merged(held: list[dict]) -> Iterator[dict]:
        last: dict | None = None
        for text, n, (gram, span, before, copies) in merge([strings(r) for r in held]):
            if last is not None and n == len(text) == len(last["text"]):
                last["copies"] += copies
                continue
            if last is not None:
                yield last
            last = {"gram": gram, "span": span, "before": before, "copies": copies, "text": text}
        if last is not None:
            yield last

    return _merged(_runs(rows, _RUN, _RUN_DDL, runs), _STRING, "gram long, span long, before long, copies long, text binary", merged)


def _part_cores(spans_: DataFrame, length: int) -> DataFrame:
    """gram, span, part, core of rows (gram, span, before, text): the parts that the span's windows fall into, by their
    distance to the anchor over NEAR, and the hash of the bytes that all windows of such a part hold."""
    schema = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("part", pa.int64()), ("core", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, span, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "span", "before"))
            data, offsets = buffers(batch.column("text"))
            for lo, hi in blocks(offsets):
                base = offsets[lo:hi] - offsets[lo]
                hashes = SpanHash(data[offsets[lo]: offsets[hi]])
                most = before[lo:hi]  # the first window's distance; the last one's follows from the text's length
                least = most - (np.diff(offsets[lo: hi + 1]) - length)
                first = least // NEAR
                n = most // NEAR - first + 1
                row = np.repeat(np.arange(hi - lo), n)
                part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                anchor = base[row] + most[row]
                core = hashes(anchor - part * NEAR, anchor + length - np.minimum(part * NEAR + NEAR - 1, length - _gram(length)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[lo + row], span[lo + row], part, core.view(np.int64))], schema=schema)

    return map_arrow(spans_.select("gram", "span", "before", "text"), run, "gram long, span long, part long, core long")


def repeated_windows(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """gram, span, start, end: windows [start, end] of a span that equal a window of another, from distinct spans with
    `parts` (part, core, hot); spans that repeat whole take part but are not told of."""
    def runs(held: list[dict]) -> Iterator[dict]:
        by: dict[int, list[list]] = {}  # span, its copies, first window and text of what belongs there
        same: dict[int, dict[bytes, list]] = {}  # the first holder of each window of hot cores
        known: dict[int, list[list[int]]] = {}  # windows that a run holds twice: gram, span, start
        for r in held:
            n = len(r["text"]) - length + 1
            for p in r["parts"]:
                a, b = max(0, r["before"] - p["part"] * NEAR - NEAR + 1), min(n, r["before"] - p["part"] * NEAR + 1)
                if not p["hot"]:
                    by.setdefault(hash(p["core"]) % buckets, []).append([r, r["copies"], a, r["text"][a: b + length - 1]])
                    continue
                for s in range(a, b):
                    window = r["text"][s: s + length]
                    bucket = xxhash.xxh3_64_intdigest(window) % buckets
                    entry = [r, r["copies"], s, window]
                    first = same.setdefault(bucket, {}).setdefault(window, entry)
                    if first is entry:
                        by.setdefault(bucket, []).append(entry)
                        continue
                    for e in (entry, first):
                        if e[1] == 1:
                            known.setdefault(bucket, []).append([e[0]["gram"], e[0]["span"], e[2]])
                    first[1] += r["copies"]
        for bucket, own in by.items():
            texts = [e[3] for e in own]
            listed = sorted((t[s: s + length], k, s) for k, t in enumerate(texts) for s in range(len(t) - length + 1))
            yield {
                "bucket": bucket, "grams": [e[0]["gram"] for e in own], "ids": [e[0]["span"] for e in own], "copies": [e[1] for e in own], "base": [e[2] for e in own],
                "texts": texts, "owner": [x[1] for x in listed], "start": [x[2] for x in listed], "shared": prefixes([x[0] for x in listed]), "known": known.get(bucket, []),
            }

    def windows(run: dict, texts: list[bytes], number: int) -> Iterator[tuple[bytes, int, object]]:
        for k, s, n in zip(run["owner"], run["start"], run["shared"]):
            yield texts[k][s: s + length], n, (number, k, s)

    def merged(held: list[dict]) -> Iterator[dict]:
        found: dict[tuple[int, int], list[int]] = {}
        last = None
        for _, n, tag in merge([windows(r, r["texts"], i) for i, r in enumerate(held)]):
            if n == length:
                for i, k, s in (last, tag):
                    if held[i]["copies"][k] == 1:
                        found.setdefault((i, k), []).append(s + held[i]["base"][k])
            last = tag
        for r in held:
            for gram, span, s in r["known"]:
                yield {"gram": gram, "span": span, "start": s, "end": s}
        for (i, k), starts in found.items():
            s = np.unique(starts)
            cuts = np.flatnonzero(np.diff(s) > 1)
            for a, b in zip(s[np.concatenate([[0], cuts + 1])].tolist(), s[np.concatenate([cuts, [len(s) - 1]])].tolist()):
                yield {"gram": held[i]["grams"][k], "span": held[i]["ids"][k], "start": a, "end": b}

    return _merged(_runs(rows, _REFER, _REFER_DDL, runs), _REPEAT, "gram long, span long, start long, end long", merged)


def repeated_ranges(texts: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """rid, ranges: sorted arrays of the byte ranges [from, to) covered by repeated strings, of texts (rid, text), whose
    rids must be the same at every reading. Ranges may touch or overlap."""
    scratch = Scratch(texts.sparkSession)
    several = scratch.put("repeated-spans", _repeated_spans(texts, length))
    parallel = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parallel, several.count() // SPANS_A_BUCKET)
    strings = scratch.put("distinct-spans", distinct_spans(_span_texts(texts, several, length), buckets))

    mixed = strings.join(strings.groupBy("gram").agg(F.count("span").alias("n")).where("n > 1").select("gram"), "gram", "left_semi")
    parts = scratch.put("parts", _part_cores(mixed, length))
    cores = parts.groupBy("core").agg(F.count("part").alias("n")).where("n > 1").select("core", (F.col("n") > HOT).alias("hot"))
    open_parts = scratch.put("open-parts", parts.join(cores, "core"))
    scratch.drop("parts")
    owners = open_parts.groupBy("gram", "span").agg(F.collect_list(F.struct("part", "core", "hot")).alias("parts"))
    dealt = strings.join(owners, ["gram", "span"]).repartition(2 * parallel)
    windows = scratch.put("repeated-windows", repeated_windows(dealt, max(4 * parallel, open_parts.count() // PARTS_A_BUCKET), length))
    scratch.drop("open-parts")

    whole = strings.where("copies > 1").select("gram", "span")
    covered = several.join(whole, ["gram", "span"]).select("rid", F.col("at").alias("from"), (F.col("last") + length).alias("to"))
    partly = several.join(windows, ["gram", "span"]).select("rid", (F.col("at") + F.col("start")).alias("from"), (F.col("at") + F.col("end") + length).alias("to"))
    ranges = covered.unionByName(partly).groupBy("rid").agg(F.array_sort(F.collect_list(F.array("from", "to"))).alias("ranges"))
    found = scratch.put("repeated-ranges", ranges)
    scratch.drop("repeated-spans", "distinct-spans", "repeated-windows")
    return found


def _union(ranges: list[list[int]] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in ranges or []:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    texts = Scratch(docs.sparkSession).numbered("texts", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rid")
    ranges = repeated_ranges(texts.select("rid", "text"), length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in ((batch.column(c)[i].as_py() for c in ("doc_id", "text", "ranges")) for i in range(batch.num_rows)):
                raw, gone = (text or "").encode("utf-8"), _union(found)
                kept = hashlib.sha256(_without(raw, gone)).hexdigest()
                out.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": kept})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(texts.join(ranges, "rid", "left").select("doc_id", "text", "ranges"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(raw: bytes, gone: list[list[int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends, in bytes."""
    at = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(sizes)])[at]
    return at[:, 0], at[:, 1]


def repeated_passages(texts: DataFrame, words: int) -> DataFrame:
    """rid, ranges: sorted arrays of the byte ranges [from, to) of every passage of `words` words that stands at two
    places at least, of texts (rid, text). Ranges may touch or overlap.

    Such a passage has 2 * words - 1 bytes or more, so it lies in a united range of repeated strings of that length. The
    range can be made of several repeats, so its passages are counted by themselves, by a digest of their bytes.
    """
    ranges = repeated_ranges(texts, 2 * words - 1)
    schema = pa.schema([("rid", pa.int64()), ("passage", pa.binary()), ("from", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = [], [], [], []
        for batch in batches:
            for rid, text, found in ((batch.column(c)[i].as_py() for c in ("rid", "text", "ranges")) for i in range(batch.num_rows)):
                raw, (starts, ends) = text.encode("utf-8"), word_places(text)
                for a, b in _union(found):
                    first, last = np.searchsorted(starts, a), np.searchsorted(ends, b, side="right")
                    for x, y in zip(starts[first: last - words + 1].tolist(), ends[first + words - 1: last].tolist()) if last - first >= words else ():
                        for column, value in zip(out, (rid, hashlib.blake2b(raw[x:y], digest_size=16).digest(), x, y)):
                            column.append(value)
                if len(out[0]) >= PASSAGES_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    scratch = Scratch(texts.sparkSession)
    held = texts.join(ranges, "rid").select("rid", "text", "ranges")
    passages = scratch.put("passages", map_arrow(held, run, "rid long, passage binary, from long, to long"))
    twice = passages.groupBy("passage").agg(F.count("rid").alias("n")).where("n > 1").select("passage")
    found = passages.join(twice, "passage", "left_semi")
    out = scratch.put("passage-ranges", found.groupBy("rid").agg(F.array_sort(F.collect_list(F.array("from", "to"))).alias("ranges")))
    scratch.drop("passages")
    return out


def strip(docs: DataFrame, length: int) -> DataFrame:
    """docs without the repeated strings of `length` bytes, as by `_strip`."""
    return _strip(docs, lambda texts: repeated_ranges(texts, length))


def strip_passages(docs: DataFrame, words: int) -> DataFrame:
    """docs without the repeated passages of `words` words, as by `_strip`."""
    return _strip(docs, lambda texts: repeated_passages(texts, words))


def _strip(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with text replaced by what is left of it, and n_chars by its length where there is such a column. A
    character of which a byte is removed goes whole; null text stays null."""
    numbered = Scratch(docs.sparkSession).numbered("numbered", docs, "__rid")
    ranges = find(numbered.select(F.col("__rid").alias("rid"), F.col("text").cast("string").alias("text")))
    joined = numbered.join(ranges.select(F.col("rid").alias("__rid"), F.col("ranges").alias("__ranges")), "__rid", "left").drop("__rid")
    names, at, found = docs.columns, docs.columns.index("text"), len(docs.columns)
    out = StructType([StructField(f.name, StringType() if f.name == "text" else LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:found]
            left = lambda t, r: t if t is None or not r else _without(t.encode("utf-8"), _union(r)).decode("utf-8", "ignore")
            columns[at] = pa.array((left(batch.column(at)[i].as_py(), batch.column(found)[i].as_py()) for i in range(batch.num_rows)), pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pc.utf8_length(columns[at]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(joined, run, out)


__all__ = ["common_prefix", "cut", "repeated_passages", "repeated_ranges", "spans", "strip", "strip_passages"]
