"""Word shingles of texts as 52-bit tokens, in bulk, and their pigeonhole signatures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geofit.llm.common import SpanHash, blocks, mix, run_bounds

TOKEN_BITS = 52
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def rounds(offsets: np.ndarray):
    """Row ranges of bounded text and of at most 2^(64 - TOKEN_BITS) rows."""
    most = 1 << (64 - TOKEN_BITS)
    for lo, hi in blocks(offsets):
        for a in range(lo, hi, most):
            yield a, min(a + most, hi)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, ascending within each document, and each document's offset among them.

    Words are what lies between white space, A-Z lower-cased. A token hashes k consecutive words; a document of
    fewer words, but not none, has its whole sequence as its one shingle.
    """
    low = _LOWER[data]
    starts, ends = run_bounds(~_SPACE[low], offsets)
    words = SpanHash(low)(starts, ends)
    first = np.searchsorted(starts, offsets)  # each document's first word
    per_doc = np.diff(first)
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    rest = np.repeat(first[1:], per_doc) - np.arange(len(words))  # words from here to the document's end
    hashed = words.copy()
    size = np.minimum(rest, k)
    for i in range(1, k):
        more = np.flatnonzero(rest > i)
        hashed[more] = mix(hashed[more] * np.uint64(3) + words[more + i])
    keep = (rest >= k) | ((per_doc[owner] < k) & (rest == per_doc[owner]))
    tokens = mix(hashed[keep] + size[keep].astype(np.uint64)) >> np.uint64(64 - TOKEN_BITS)
    keyed = tokens | (owner[keep].astype(np.uint64) << np.uint64(TOKEN_BITS))
    keyed.sort()
    if len(keyed):
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    own = (keyed >> np.uint64(TOKEN_BITS)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(per_doc)))])
    return keyed & np.uint64((1 << TOKEN_BITS) - 1), at


@dataclass(frozen=True)
class Similar:
    """Links two sets when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def most_apart(self, larger: int) -> int:
        """The greatest symmetric difference of a linked pair whose smaller set has at most this size."""
        return larger * (self.den - self.num) // self.num

    def parts(self, larger: int) -> tuple[int, int]:
        """Parts of the token space for a class whose smaller sets have at most this size, and in how many of
        them two linked sets agree at least. The parts beyond most_apart + 1 make chance agreement not enough."""
        apart = self.most_apart(larger)
        return apart + 1 + apart // 2, 1 + apart // 2

    def size_classes(self, largest: int) -> list[tuple[int, int]]:
        """[from, to) of set sizes; a linked pair lies in one class or in two neighbours."""
        out, lo = [], 1
        while lo <= largest:
            hi = lo * self.den // self.num + 1
            out.append((lo, hi))
            lo = hi
        return out


def signatures(tokens: np.ndarray, at: np.ndarray, similar: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, signature and the number of signatures that a linked pair shares at least.

    A size class cuts the space of tokens into more parts than two linked sets can differ in tokens, so that
    they agree in some parts whole; a signature stands for a part's number and content. A document has the
    signatures of its own class and, as a possible larger partner, of the class below.
    """
    sizes = np.diff(at)
    classes = similar.size_classes(int(sizes.max(initial=0)))
    ends = np.array([hi for _, hi in classes], np.int64)
    parts_of, agree = np.array([similar.parts(hi - 1) for _, hi in classes], np.int64).reshape(-1, 2).T
    own = np.searchsorted(ends, sizes, side="right")
    salted = mix(tokens)
    low, high = (salted & np.uint64((1 << 26) - 1)).astype(np.float64), (salted >> np.uint64(38)).astype(np.float64)
    place = (mix(tokens ^ np.uint64(0xA5A5A5A5A5A5)) >> np.uint64(32)).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for down in (0, 1):
        scheme = own - down
        # A larger partner's size is at most den / num of the greatest size of the class below.
        used = (sizes > 0) & (scheme >= 0)
        scheme = np.maximum(scheme, 0)
        if not used.any():
            continue
        if down:
            used &= sizes * similar.num <= (ends[scheme] - 1) * similar.den
        n_parts = np.where(used, parts_of[scheme], 0)
        base = np.cumsum(n_parts) - n_parts
        total = int(n_parts.sum())
        mine = used[doc]
        slot = base[doc[mine]] + (place[mine] * n_parts[doc[mine]] >> 32)
        sums = [np.bincount(slot, weights=w[mine], minlength=total).astype(np.uint64) for w in (low, high)]
        part = np.arange(total) - np.repeat(base, n_parts)
        label = np.repeat(scheme, n_parts).astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64)
        signs = mix(mix(sums[0] + (sums[1] << np.uint64(31))) ^ mix(label))
        found.append((np.repeat(np.arange(len(sizes)), n_parts), signs, np.repeat(agree[scheme], n_parts)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def set_keys(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; equal sets have equal keys."""
    out = []
    for seed in (0x1234567, 0x89ABCDE):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(seed)), dtype=np.uint64)])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]
