"""A suffix array by difference cover, one suffix bucket at a time, and what it says of repeats.

The cover is a set of residues such that for any two positions some shift below the period brings
both into the sample. Sample suffixes are ranked first, by doubling steps of the period. Suffixes
are then sorted a bucket (first byte) at a time: by a few bytes, and what still ties by the ranks of
the sample suffixes that the residues' common shift leads to. Memory is bounded by the sample and
one bucket.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set, every difference modulo 13 occurs once.
PERIOD, COVER = 13, (0, 1, 3, 9)
_HEAD = 16  # bytes that are compared outright; at least the period


def _shifts() -> np.ndarray:
    """shift[r, s]: how far from residues r and s both are in the cover."""
    cover = set(COVER)
    return np.array([[next(d for d in range(PERIOD) if {(r + d) % PERIOD, (s + d) % PERIOD} <= cover) for s in range(PERIOD)] for r in range(PERIOD)])


SHIFT = _shifts()


def words_at(text: np.ndarray, reach: int) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number; zeros follow the text's end, for `reach` bytes."""
    out = np.zeros(len(text) + reach, np.uint64)
    for i in range(8):
        out[: max(0, len(text) - i)] |= text[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the rows by keys, equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def sample_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of each sample suffix of the n positions by depth bytes at least; 0 elsewhere and beyond the end."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + depth + 4 * PERIOD + _HEAD, np.int64)
    rank[at] = _dense(words[at], words[at + 8]) if len(at) else 0
    step, known = PERIOD, _HEAD
    while known < depth and len(at) and rank.max() < len(at):
        # `step` bytes on, a multiple of the period, is in the sample again
        step = known // PERIOD * PERIOD
        rank[at] = _dense(rank[at], rank[np.minimum(at + step, len(rank) - 1)])
        known += step
    return rank


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the suffixes that begin there, by depth bytes at least."""
    words = words_at(text, depth + 4 * PERIOD + _HEAD)
    ranks = sample_ranks(words, len(text), depth)
    first = text[starts]
    by_bucket = starts[np.argsort(first, kind="stable")]
    ends = np.cumsum(np.bincount(first, minlength=256))
    out = [_sort_bucket(words, ranks, by_bucket[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if b > a]
    return np.concatenate(out) if out else starts


def _sort_bucket(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    head = _dense(words[at], words[at + 8])
    order = np.argsort(head, kind="stable")
    at, head = at[order], head[order]
    same = np.zeros(len(at), bool)
    same[1:] = head[1:] == head[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    where = np.flatnonzero(tied)
    if not len(where):
        return at
    pos, group = at[where], head[where].astype(np.int64)
    residue = pos % PERIOD
    wide = np.int64(ranks.max() + 1)
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    ahead = np.zeros(len(pos), np.int64)  # how many of the group, and of groups before, come before
    for r in range(PERIOD):
        if not len(members[r]):
            continue
        for s in range(PERIOD):
            if not len(members[s]):
                continue
            d = SHIFT[r, s]
            other = np.sort(group[members[s]] * wide + ranks[pos[members[s]] + d])
            ahead[members[r]] += np.searchsorted(other, group[members[r]] * wide + ranks[pos[members[r]] + d])
    at[where] = pos[np.argsort(ahead, kind="stable")]  # groups stay where they are: they come before as wholes
    return at


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of starts whose `length` bytes stand at another of them too; length bytes must follow each start."""
    if len(starts) < 2:
        return starts[:0]
    order = sorted_suffixes(text, starts, length)
    words = words_at(text, length + 8)
    near = np.arange(len(order) - 1)
    for i in (*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])):
        near = near[words[order[near] + i] == words[order[near + 1] + i]]
    if length < 8:
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * length)) & 0xFFFFFFFFFFFFFFFF)
        near = near[(words[order[near]] & mask) == (words[order[near + 1]] & mask)]
    return np.unique(np.concatenate([order[near], order[near + 1]]))
