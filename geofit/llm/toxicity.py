"""Toxicity by a weighted lexicon.

Texts are folded before anything is matched: compatibility forms and case, accents, letters of other scripts that look
Latin, and digits and signs that stand for letters inside a word; i and l, which 1, ! and | may both mean, are one. What
is left are words of letters with one space between them. Terms of the lexicon are folded words (written with a space
at the end) and stems, with which a word begins; a word counts by the heaviest of its terms.

The lexicon is learnt from labelled documents. A term's weight is the log odds of a toxic document to hold it against
a clean one, less DOUBT standard errors, so that a word of few documents weighs little; a stem goes where a longer term
tells as much. Exception phrases are words with a term, alone or with a neighbour, that clean documents hold rather than
toxic ones; inside such a phrase the term does not count. One Aho-Corasick automaton finds terms and phrases in one pass over a text. The sum of the weights over the number of words
(and PRIOR_WORDS more, so that a single word of a short text does not decide) goes through a logistic curve, which is
fitted to documents scored by the lexicon of the other half of the learning documents.

At most MOST_LABELS labelled documents, drawn by the hash of their ids, are learnt from: the list of their ids is the one
table that is broadcast, so that no text is moved to meet its label. Document counts are sums over all of them, added up
in each task and then by Spark. The model is the
LEXICON_TERMS strongest terms and as many phrases at most, so it is small and broadcast; scoring shuffles nothing.

Null and empty texts have no words and the curve's lowest score. Labels of one document are one label, toxic if any is;
a null label or doc_id teaches nothing. Without toxic or without clean labels there is no lexicon and all scores are
low. Repeated rows count and are scored each. Texts are scored whole, one at a time. Other columns are not carried.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofit.llm.common import Scratch, map_arrow

LEXICON_TERMS = 20_000
#: Labelled documents that are learnt from, at most; 16 bytes each.
MOST_LABELS = 50_000
LEAST_WEIGHT = 1.0
DOUBT = 1.5
#: Letters of a stem.
STEM = range(4, 10)
#: A stem goes if a longer term is in so large a part of its toxic documents.
SAME = 0.9
#: Documents that must hold a term, or a phrase, before it is believed.
LEAST_DOCUMENTS = 2
PRIOR_WORDS = 30
PREDICT_AT = 0.7
#: Steps of the curve's input in which learning documents are counted.
STEPS = 64

# Letters of other scripts by the Latin letter they look like, and signs by the letter they stand for.
LOOKALIKES = {
    "a": "аαɑ", "b": "вьβ", "c": "сϲ", "d": "ԁđð", "e": "еεє", "g": "ɡց", "h": "һнհ", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏłǀ", "m": "м", "n": "ոη",
    "o": "оοσօø", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսμ", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LATIN = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
_SIGNS = str.maketrans(SIGNS)
_ONE = str.maketrans("l", "i")
_MARKS = re.compile("[\u0300-\u036f]+")
_SIGN_RUN = re.compile(r"[013457890@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    t = (text or "").casefold()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).translate(_LATIN)
    t = _SIGN_RUN.sub(lambda m: m[0].translate(_SIGNS), t)
    return _WORD.findall(t.translate(_ONE))


def keys_of(words: list[str]) -> set[str]:
    """The terms that a document's words may be."""
    own = set(words)
    return {w + " " for w in own} | {w[:n] for w in own for n in STEM if n <= len(w)}


@dataclass
class Lexicon:
    """Weights of terms, phrases of folded words that excuse the terms in them, and the curve."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    bias: float = -5.0

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._machine.add_word(f" {term}", (len(term), weight, term))
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (len(phrase) + 1, None, phrase))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, words: list[str]) -> tuple[list[tuple[float, str]], int]:
        """The terms that count, one for each word that has any, and the number of words that a phrase excuses."""
        if not len(self.machine) or not words:
            return [], 0
        found, excused = {}, []
        for end, (n, weight, term) in self.machine.iter(f" {' '.join(words)} "):
            if weight is None:
                excused.append((end - n, end))
            else:
                found[end - n] = max(found.get(end - n, (0.0, "")), (weight, term))
        kept = [h for at, h in found.items() if not any(a <= at < b for a, b in excused)] if excused else list(found.values())
        return kept, len(found) - len(kept)

    def input(self, found: list[tuple[float, str]], n_words: int) -> float:
        """What the curve is a function of: the weight of the hits by length of text, on a scale of logarithms."""
        return math.log1p(200 * sum(h[0] for h in found) / (n_words + PRIOR_WORDS))

    def curve(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * x + self.bias))))


def _weight(a: Column, n: Column, toxic: int, clean: int) -> Column:
    """Log odds, less the doubt, of a term held by n documents, a of them toxic."""
    b = n - a
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    return odds - DOUBT * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """words (folded, by spaces), toxic and half of `most` labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id").select("text", "toxic")
    schema = pa.schema([("words", pa.string()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(fold(t.as_py())) for t in batch.column(0)], pa.string()), batch.column(1)], schema=schema)

    folded = map_arrow(texts, run, "words string, toxic int")
    return folded.withColumn("half", F.pmod(F.xxhash64("words"), F.lit(2)).cast("int"))  # copies are in one half


def _counted(folded: DataFrame, listed) -> DataFrame:
    """key, and for either half n0, n1 (documents that hold it) and a0, a1 (toxic ones), summed per batch and by Spark.
    `listed` gives the keys of a document from its words."""
    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("n0", "a0", "n1", "a1")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, Counter] = {k: Counter() for k in range(4)}
            for words, toxic, half in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                keys = set(listed(words.split(" ") if words else []))
                sums[2 * half].update(keys)
                if toxic:
                    sums[2 * half + 1].update(keys)
            keys = list(sums[0].keys() | sums[2].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([sums[k][x] for x in keys], pa.int64()) for k in range(4)]], schema=schema)

    rows = map_arrow(folded.select("words", "toxic", "half"), run, "key string, n0 long, a0 long, n1 long, a1 long")
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "a0", "n1", "a1")])


def _terms(counts: DataFrame, a: Column, n: Column, toxic: int, clean: int, most: int) -> dict[str, float]:
    if not toxic or not clean:
        return {}
    weighed = counts.where(a >= LEAST_DOCUMENTS).select("key", a.alias("held"), _weight(a, n, toxic, clean).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    rows = {r.key: (r.held, r.weight) for r in weighed.orderBy(F.desc("weight"), "key").limit(most).collect()}
    told: dict[str, int] = {}  # the most toxic documents that a longer term with this beginning is in
    for key, (held, _) in rows.items():
        for n_ in range(STEM[0], len(key)):
            told[key[:n_]] = max(told.get(key[:n_], 0), held)
    return {key: weight for key, (held, weight) in rows.items() if told.get(key, 0) < SAME * held}


def _exceptions(folded: DataFrame, terms: dict[str, float], toxic: int, clean: int, most: int) -> list[str]:
    """Words with a term, alone or with a neighbour, that clean documents hold more than toxic ones, beyond doubt."""
    if not terms:
        return []
    known = folded.sparkSession.sparkContext.broadcast(terms)

    def around(words: list[str]) -> Iterator[str]:
        for i, w in enumerate(words):
            if w + " " in known.value or any(w[:n] in known.value for n in STEM):
                yield w
                if i:
                    yield f"{words[i - 1]} {w}"
                if i + 1 < len(words):
                    yield f"{w} {words[i + 1]}"

    n, a = F.col("n0") + F.col("n1"), F.col("a0") + F.col("a1")
    b = n - a
    odds = F.log((b + 0.5) / (clean + 1)) - F.log((a + 0.5) / (toxic + 1)) - DOUBT * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    found = _counted(folded, around).where(b >= LEAST_DOCUMENTS).select("key", odds.alias("odds")).where("odds > 0")
    return [r.key for r in found.orderBy(F.desc("odds"), "key").limit(most).collect()]


def _fit(folded: DataFrame, halves: list[Lexicon], whole: Lexicon) -> None:
    """Sets the curve of `whole` from documents scored by the lexicon of the half they are not in."""
    shared = folded.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = []
            for words, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own, lexicon = words.split(" ") if words else [], shared.value[1 - half]
                step.append(round(STEPS * lexicon.input(lexicon.hits(own)[0], len(own))))
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), batch.column(1)], names=["step", "toxic"])

    # A few hundred rows, whatever the documents: the steps are bounded by the greatest weight.
    rows = map_arrow(folded.select("words", "toxic", "half"), run, "step long, toxic int").groupBy("step", "toxic").count().collect()
    if len({r.toxic for r in rows}) < 2:
        return
    x, y, n = (np.array(v, float) for v in ([r.step / STEPS for r in rows], [r.toxic for r in rows], [r["count"] for r in rows]))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, -3.0])
    damp = np.diag([0.05, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (p - y)) + damp @ beta
        step = np.linalg.solve((design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + damp, gradient)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    whole.slope, whole.bias = max(0.0, float(beta[0])), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None, most: int = LEXICON_TERMS, most_labels: int = MOST_LABELS) -> Lexicon:
    """The lexicon of docs (doc_id, text) labelled by labels (doc_id, toxic); `exceptions` (texts) add to those learnt."""
    scratch = Scratch(docs.sparkSession)
    folded = scratch.put("folded", _labelled(docs, labels, most_labels))
    held = {(r.half, r.toxic): r["count"] for r in folded.groupBy("half", "toxic").count().collect()}
    size = lambda toxic, *halves: sum(held.get((h, toxic), 0) for h in halves)
    counts = scratch.put("terms", _counted(folded, keys_of))
    n, a = F.col("n0") + F.col("n1"), F.col("a0") + F.col("a1")
    terms = _terms(counts, a, n, size(1, 0, 1), size(0, 0, 1), most)
    phrases = [" ".join(fold(e)) for e in exceptions or []] + _exceptions(folded, terms, size(1, 0, 1), size(0, 0, 1), most)
    whole = Lexicon(terms, phrases)
    halves = [Lexicon(_terms(counts, F.col(f"a{h}"), F.col(f"n{h}"), size(1, h), size(0, h), most), phrases) for h in (0, 1)]
    _fit(folded, halves, whole)
    scratch.drop("folded", "terms")
    return whole


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_words, hits (terms that count, in folded form, once each), n_hits, n_excused, score of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.string())), ("n_hits", pa.int64()), ("n_excused", pa.int64()), ("score", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = fold(text.as_py())
                found, excused = own.hits(words)
                rows.append((len(words), sorted({h[1] for h in found}), len(found), excused, own.curve(own.input(found, len(words)))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, fields[1:])]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_words long, hits array<string>, n_hits long, n_excused long, score double")
