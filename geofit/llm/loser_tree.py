"""Merging sorted runs of byte strings without comparing known common prefixes again."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    for step in (64, 8, 1):
        while a[known: known + step] == b[known: known + step]:
            known += step
    return known


def prefixes(ranked: list[bytes]) -> list[int]:
    """Each string's common prefix with its predecessor."""
    return [0, *(common_prefix(a, b) for a, b in zip(ranked, ranked[1:]))][: len(ranked)]


def merge(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """One ascending sequence of (string, common prefix with the string before, tag) from such sequences.

    A head's prefix is the one it shares with the last string put out. Of two heads, the longer prefix is the lesser
    string, and nothing is compared; of equal ones, bytes are compared from there on, and the loser keeps what it
    shares with the winner - which is what it shares with the last string when its turn comes.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[bytes, int, object] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0 if h is not None else -1 for h in heads]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = heads[a][0], heads[b][0]
        n = common_prefix(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while shared[top] >= 0:
        text, _, tag = heads[top]
        yield text, shared[top], tag
        heads[top] = head = next(runs[top], None)
        shared[top] = -1 if head is None else head[1]
        node = (top + size) >> 1
        while node:
            other = losers[node]
            x, y = shared[top], shared[other]
            if y > x or (x == y and x >= 0):
                top, losers[node] = play(top, other)
            node >>= 1
