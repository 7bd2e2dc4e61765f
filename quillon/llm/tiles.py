"""Tiled comparison of 64-bit fingerprints: XOR and bit counts, tile against tile.

Rows are sorted by population count, so a tile pair whose counts differ beyond the radius is skipped:
flipping one bit changes the count by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.components import local_roots

TILE = 1024
#: Rows of one key that a task compares; at most twice as many are not dealt to more tasks.
GROUP_ROWS = 8192


def majority(digests: np.ndarray) -> bytes:
    """The SimHash of 64-bit hashes, given as rows of eight bytes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests)).tobytes()


def near_pairs(fps: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints within radius bits, each once, a tile pair at a time."""
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    x, ones = fps[order], ones[order].astype(np.int64)
    for i in range(0, len(x), tile):
        left, most = x[i : i + tile], ones[min(i + tile, len(x)) - 1]
        for j in range(i, len(x), tile):
            if ones[j] - most > radius:
                break  # later tiles have still larger counts
            a, b = np.nonzero(np.bitwise_count(left[:, None] ^ x[None, j : j + tile]) <= radius)
            up = (a + i) < (b + j)
            yield order[a[up] + i], order[b[up] + j]


def tile_roots(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Root index of each fingerprint under links of radius bits or fewer."""
    root = np.arange(len(fps))
    for a, b in near_pairs(fps, radius, tile):
        root = local_roots(len(fps), np.concatenate([np.arange(len(fps)), a]), np.concatenate([root, b]))
    return root


def links_in_groups(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is within radius inside each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= 32, sizes)
    a, b = [], []
    kept = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
    k, x = key[kept], fps[kept]
    for shift in range(1, 32):  # all small groups at once: each row against the shift-th after it
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        near = same & (np.bitwise_count(x[shift:] ^ x[:-shift]) <= radius)
        a.append(x[:-shift][near])
        b.append(x[shift:][near])
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        group = np.unique(fps[s : s + n])
        root = tile_roots(group, radius)
        moved = root != np.arange(len(group))
        a.append(group[moved])
        b.append(group[root[moved]])
    if not a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def whole_groups(batches: Iterator, columns: int, rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first, as arrays of `rows` rows or more that hold groups of equal keys whole."""
    held = [np.empty(0, np.int64)] * columns
    for b in batches:
        held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
        if last > rows:
            yield [h[:last] for h in held]
            held = [h[last:] for h in held]
    if len(held[0]):
        yield held


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def dealt(keyed: DataFrame, radius: int, rows: int | None = None) -> DataFrame:
    """keyed (key, fp, ..) so that groups of one key are what a task should hold, and rows within radius bits still meet.

    A key with over 2 * rows rows is made finer if the radius is below eight: of the residue classes of bit places modulo
    radius + 1, such rows agree on one at least. What is still too large is cut into tiles that meet pairwise.
    """
    rows = rows or GROUP_ROWS

    def sized(df: DataFrame) -> DataFrame:
        large = df.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * rows).select("key", F.ceil(F.col("rows") / rows).cast("int").alias("cuts"))
        return df.join(materialize(large, "large-keys"), "key", "left")  # written, so that Spark can split a frequent key's rows

    first = sized(keyed)
    second = first.where("cuts is not null")
    if radius < 8:
        classes = [sum(1 << bit for bit in range(c, 64, radius + 1)) for c in range(radius + 1)]
        finer = F.array(*(F.xxhash64("key", F.lit(c), F.col("fp").bitwiseAND(F.lit(signed(mask)))) for c, mask in enumerate(classes)))
        second = sized(second.drop("cuts").withColumn("key", F.explode(finer)))
    cut = F.coalesce("cuts", F.lit(1))
    tiled = second.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("tile")), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    tiled = tiled.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "cuts")
    return first.where("cuts is null").drop("cuts").unionByName(tiled)
