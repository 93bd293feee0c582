"""Packing documents into sequences by power-of-two decomposition.

A document of n tokens is cut into as many full windows as fit and then into pieces whose lengths are the
powers of two in the binary form of the rest, longest first. Every piece is a sequence of its own: equal
lengths form a bucket from which batches are drawn, no sequence crosses documents, and nothing is padded.
There is no shuffle: a task tokenises its rows and numbers its pieces within its own range of ids.

Tokenising is exact and cheap. The tokenizer treats text between white space, and on either side of a change
between ASCII letters, digits and punctuation, independently; so a task hashes such words in bulk and asks
the tokenizer only for words that it has not met lately.

Null text is the empty text; its document is the end id alone. Repeated rows are packed once each. Other
columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import SpanHash, blocks, buffers, distinct, map_arrow, run_bounds

WINDOW = 4096
END_ID = 2
#: Words whose ids a task remembers before it starts afresh.
REMEMBERED_WORDS = 3_000_000

_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _PUNCT
    kind[ord("'")] = _OTHER  # it can begin a piece that goes on with letters
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kind


_KIND = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Whether two neighbouring bytes of these classes always belong to different pieces.
_CUTS = np.zeros((5, 5), bool)
for _a in (_LETTER, _DIGIT, _PUNCT):
    for _b in (_LETTER, _DIGIT, _PUNCT):
        _CUTS[_a, _b] = _a != _b or _a == _DIGIT


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which outlives its tasks."""
    return WordIds(path)


class WordIds:
    """Token ids of whole documents, through a bounded memory of the words met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Lower-case ASCII letters are one piece and stay as they are, so only white space matters to them.
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words, given with their hashes in ascending order."""
        counts, at, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.flat]
        plain = np.fromiter(map(str.isascii, words), bool, len(words)) & np.fromiter(map(str.isalpha, words), bool, len(words))
        total = len(self.flat)
        for chosen, tokenizer in ((np.flatnonzero(plain), self.plain), (np.flatnonzero(~plain), self.tokenizer)):
            for lo in range(0, len(chosen), 100):
                part = [words[i] for i in chosen[lo: lo + 100]]
                done = tokenizer.encode(" ".join(part), add_special_tokens=False)
                ids.append(np.array(done.ids, np.uint32))
                if tokenizer is self.plain:
                    own = np.bincount(np.array(done.word_ids, np.int64), minlength=len(part))
                else:
                    starts = np.cumsum([0] + [len(w) + 1 for w in part])[:-1]
                    begun = np.fromiter((a for a, _ in done.offsets), np.int64, len(done.ids))
                    own = np.bincount(np.searchsorted(starts, begun, side="right") - 1, minlength=len(part))
                counts[chosen[lo: lo + 100]] = own
                at[chosen[lo: lo + 100]] = total + np.cumsum(own) - own
                total += len(done.ids)
        self.flat = np.concatenate(ids)
        first = at
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = np.insert(self.known, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents, one after another, and each document's offset among them."""
        low = _LOWER[data]
        kind = _KIND[low]
        cut = np.flatnonzero(_CUTS.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]) + 1
        starts, ends = run_bounds(kind != _SPACE, np.concatenate([cut, offsets]))
        hashes = SpanHash(low)(starts, ends) ^ (ends - starts).astype(np.uint64)
        words, sample, which = distinct(hashes)
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, words), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != words) if len(self.known) else np.arange(len(words))
        if len(new):
            text = low.tobytes()
            self.learn(words[new], [text[a:b].decode("utf-8") for a, b in zip(starts[sample[new]], ends[sample[new]])])
        at = np.searchsorted(self.known, words)[which]
        counts = self.count[at]
        ends_ids = np.cumsum(counts)
        total = int(ends_ids[-1]) if len(ends_ids) else 0
        ids = self.flat[np.repeat(self.first[at] - (ends_ids - counts), counts) + np.arange(total)]
        before = np.concatenate([[0], ends_ids])
        return ids, before[np.searchsorted(starts, offsets)]


def pieces(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the powers of two of the rest."""
    out = [(at, window) for at in range(0, n - n % window, window)]
    at = n - n % window
    for bit in range(window.bit_length() - 2, -1, -1):
        if n >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length (the bucket), ids_crc32, doc_tokens, ids when asked for,
    sequence_id (the bucket's exponent in the top bits) and offset.

    The window must be a power of two. The numbering holds as long as the same rows are read in the same
    file splits, so a recomputed task gives the same ids.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for lo, hi in blocks(offsets):
                ids, at = words.encode(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                out: dict[str, list] = {name: [] for name in schema.names}
                for k in range(hi - lo):
                    own = np.append(ids[at[k]: at[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for start, length in pieces(len(own), window):
                        part = own[start: start + length]
                        out["doc_id"].append(doc_ids[lo + k])
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        out["doc_tokens"].append(len(own))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    cut = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ddl)
    exponent = F.length(F.conv(F.col("length").cast("string"), 10, 2)) - 1
    return cut.withColumn(
        "sequence_id", F.shiftleft(exponent.cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    ).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in one folder for each length, so that a reader draws a batch of equal lengths."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
