"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to three characters, words padded by a space) in
the order of their counts over all learning documents. A document's own most frequent n-grams are ranked alike,
and its distance to a profile is the sum, over them, of how far out of place each is; one that the profile lacks
costs the most. The nearest profile is the prediction.

Counting is bulk work inside tasks: grams are 64-bit codes, sorted together with their document's number. Learning
sums counts per language in Spark after each task has summed its own; prediction needs no shuffle. What is broadcast
are the profiles: at most PROFILE_GRAMS rows for each language, and languages are few by nature (checked).

Only ASCII and other cased letters are lower-cased and every non-letter separates words. A null text or one without
a letter is `und` with score 0. Ties between languages go to the alphabetically first. A document with null lang
teaches nothing but is predicted. Without anything to learn from every text is `und`. Repeated rows count each time.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from geofit.llm.common import map_arrow

UNKNOWN = "und"
PROFILE_GRAMS = 400
DOCUMENT_GRAMS = 300
#: Profiles are broadcast; more languages than this are refused.
MOST_LANGUAGES = 2000
_CHARS = 1 << 19  # characters in one round of counting


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower case if a letter, else a space. One-to-many lower cases keep the letter itself."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between spaces, runs of spaces as one; the document of each."""
    joined = " ".join(["", *[t or "" for t in texts], ""])
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(t or "") + 1 for t in texts])
    docs = np.concatenate([np.zeros(1, np.int64), np.repeat(np.arange(len(texts)), sizes)])
    keep = (points != 32)
    keep[1:] |= points[:-1] != 32
    keep[0] = True
    return points[keep], docs[keep]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count), by document. A gram is up to three characters of 21 bits; a space stands only at
    a word's edge."""
    points, docs = _normal(texts)
    seen = np.zeros(len(_letters()), bool)
    seen[points] = True
    seen[32] = True
    alphabet = np.flatnonzero(seen)  # the space is first: no letter comes before it
    size = len(alphabet)
    if (size**3 + size**2 + size) * (len(texts) + 1) >= 1 << 63 and len(texts) > 1:  # too many letters for one sort key
        half = len(texts) // 2
        (d1, g1, n1), (d2, g2, n2) = gram_counts(texts[:half]), gram_counts(texts[half:])
        return np.concatenate([d1, d2 + half]), np.concatenate([g1, g2]), np.concatenate([n1, n2])
    place = np.zeros(len(seen), np.int32)
    place[alphabet] = np.arange(size)
    p = place[points].astype(np.int64)
    letter = p != 0
    # Keys: document, then the kind of gram (1, 2 or 3 characters), then its characters.
    whole, square = size**3, size**2
    base = docs * (whole + square + size)
    pairs = [(base + p)[letter]]
    if len(p) > 1:
        pairs.append(base[1:] + size + p[:-1] * size + p[1:])
    if len(p) > 2:
        pairs.append((base[1:-1] + size + square + (p[:-2] * size + p[1:-1]) * size + p[2:])[letter[1:-1]])
    keys = np.concatenate(pairs)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    doc, rest = np.divmod(keys[first], whole + square + size)
    one, two = rest < size, (rest >= size) & (rest < size + square)
    rest = rest - np.where(one, 0, np.where(two, size, size + square))
    points = alphabet[[rest // square, rest // size % size, rest % size]]
    gram = np.where(one, 0, points[1] << 21) + np.where(one | two, 0, points[0] << 42) + points[2]
    return doc, gram.astype(np.uint64), counts


def top_grams(texts: list[str | None], most: int = DOCUMENT_GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, rank from 0) of each document's most frequent grams; ties by gram code."""
    doc, gram, count = gram_counts(texts)
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    keep = rank < most
    return doc[keep], gram[keep], rank[keep]


def _rounds(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > _CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def learn(docs: DataFrame, profile_grams: int = PROFILE_GRAMS) -> DataFrame:
    """lang, gram, rank: the profiles of all languages in docs (text, lang)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in _rounds(own):
                    _, gram, n = gram_counts(own[lo:hi])
                    if lang in held:
                        gram, n = np.concatenate([held[lang][0], gram]), np.concatenate([held[lang][1], n])
                    codes, which = np.unique(gram, return_inverse=True)
                    held[lang] = codes, np.bincount(which, weights=n, minlength=len(codes)).astype(np.int64)
        for lang, (gram, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], schema=schema)

    taught = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = map_arrow(taught, run, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return summed.withColumn("rank", rank).where(F.col("rank") < profile_grams).select("lang", "gram", "rank")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], profile_grams: int):
        self.langs = sorted({r[0] for r in rows})
        self.worst = profile_grams
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.uint64)) if rows else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.grams, np.uint64(gram)), at[lang]] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 less the distance as a share of the greatest."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        doc, gram, rank = top_grams(texts)
        if not self.langs or not len(doc):
            return langs, scores
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at[self.grams[at] != gram] = len(self.grams)
        known = self.rank[at]
        away = np.where(known < 0, self.worst, np.minimum(np.abs(known - rank[:, None]), self.worst))
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total = np.add.reduceat(away, starts, axis=0)
        sizes = np.diff(np.append(starts, len(doc)))
        best = total.argmin(axis=1)
        for d, b in zip(doc[starts].tolist(), best.tolist()):
            langs[d] = self.langs[b]
        scores[doc[starts]] = 1 - total[np.arange(len(best)), best] / (sizes * self.worst)
        return langs, scores


def identify(docs: DataFrame, profiles: DataFrame, profile_grams: int = PROFILE_GRAMS) -> DataFrame:
    """docs with lang_pred and score, found from text alone; columns of those names are replaced."""
    rows = [tuple(r) for r in profiles.select("lang", "gram", "rank").collect()]
    if len(rows) > MOST_LANGUAGES * profile_grams:
        raise ValueError("too many languages to broadcast their profiles")
    shared = docs.sparkSession.sparkContext.broadcast((rows, profile_grams))
    kept = docs.drop("lang_pred", "score")
    fields = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(*shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in _rounds(texts):
                langs, scores = made.predict(texts[lo:hi])
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*own.schema.names, "lang_pred", "score"])

    return map_arrow(kept, run, fields)


def held_out() -> Column:
    """Whether a document's crc32 of its id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
