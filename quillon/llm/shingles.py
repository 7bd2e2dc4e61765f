"""SimHash near-dedup at a stated Jaccard similarity of word shingles.

Fingerprints of 64 bits place two texts at a similarity of 0.8 some 10 bits apart, and one pair in a
million beyond 24. No choice of bit blocks routes such a radius, so here

1. texts with the same set of shingles are one node, with the SimHash of the set;
2. a node has 32 routing keys of five minimum hashes each. Of two nodes at a similarity of 0.8, all
   keys differ with a chance of 3 in a million, and with less above;
3. within a key, fingerprints are compared by XOR and bit counts; those within the radius are
   candidates, and a candidate is a link only if the similarity of the sets themselves is high enough;
4. all nodes of a key are compared with its smallest first. Those that end up in its component need no
   more comparisons with each other; the others are compared tile by tile (tiles.py), the nearest
   fingerprints first, with all that are not yet in their component, and only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize, release_shuffles, tidy
from quillon.llm.components import connected_components, labels
from quillon.llm.tiles import dealt, majority, near_pairs

SEED = 42
RADIUS = 24
#: Nodes of one key whose sets a task compares; at most twice as many are not dealt to more tasks.
GROUP_ROWS = 512
BANDS, ROWS = 32, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)


def shingle_hashes(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 bytes: A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle, one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its number and of its minimum hashes. None for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(hashes), 512):
        mixed = low[at : at + 512, None] * _FACTORS[0]
        mixed += high[at : at + 512, None] * _FACTORS[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def _nodes(docs: DataFrame, shingle: int, kind: T.DataType) -> DataFrame:
    """(id, text_hash, node, n, fp, keys) of rows (id, text_hash, text): node is a hash of the set, n its size, fp its SimHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fps = np.frombuffer(b"".join([majority(s.view(np.uint8).reshape(-1, 8)) for s in sets]), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), keys], ["id", "text_hash", "node", "n", "fp", "keys"])

    to = [("id", kind), ("text_hash", T.LongType()), ("node", T.LongType()), ("n", T.LongType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(tidy(run), T.StructType([T.StructField(*c) for c in to]))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, text), hashes in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(shingle_hashes(t, shingle).view(np.int64)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(tidy(run), "node long, hashes array<long>")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key after the other, of batches sorted by key."""
    held = None
    for b in batches:
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        key = held.column("key").to_numpy()
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1].tolist()
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield held.slice(lo, hi - lo)
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _group_links(rows: pa.Table, similarity: float, radius: int) -> Iterator[tuple[int, int]]:
    """Links between nodes of different roots in one key, one of them outside the root of the key's centre: a spanning forest of them."""
    fp, node, n, root, centre, routing = (rows.column(c).to_numpy() for c in ("fp", "node", "n", "root", "centre_root", "routing"))
    outside = root != centre
    if not outside.any() or (root == root[0]).all():
        return
    keys = np.stack([k.values.to_numpy() for k in rows.column("keys")])
    band = int(np.argmax(keys[0] == routing[0]))
    hashes = [h.values.to_numpy() for h in rows.column("hashes")]
    parts = []
    for i, j in near_pairs(fp.view(np.uint64), radius):
        asked = (root[i] != root[j]) & (outside[i] | outside[j]) & (n[i] >= similarity * n[j]) & (n[j] >= similarity * n[i])
        i, j = i[asked], j[asked]
        first = np.concatenate([np.argmax(keys[i[at : at + 8192]] == keys[j[at : at + 8192]], axis=1) for at in range(0, len(i), 8192)]) == band if len(i) else np.empty(0, bool)
        parts.append((i[first], j[first]))  # a pair is looked at in the first key that it shares
    if not parts:
        return
    i, j = (np.concatenate(p) for p in zip(*parts, strict=True))
    nearest = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
    up = dict(zip(root.tolist(), root.tolist(), strict=True))

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    for a, b in zip(i[nearest].tolist(), j[nearest].tolist(), strict=True):
        x, y = top(int(root[a])), top(int(root[b]))
        if x == y:
            continue
        small, large = sorted((hashes[a], hashes[b]), key=len)
        common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if common >= similarity * (len(small) + len(large) - common):
            up[x] = y
            yield int(node[a]), int(node[b])


def tile_links(placed: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that _group_links finds in the keys of placed (key, fp, node, n, root, centre_root), with sets (node, keys, hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            links = np.array(list(_group_links(rows, similarity, radius)), np.int64).reshape(-1, 2)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    groups = materialize(dealt(placed.withColumn("routing", F.col("key")), radius, GROUP_ROWS), "dealt-members")
    return groups.join(sets, "node").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(id, component_id) for every row of docs: component_id is the smallest id reachable over links.

    Two texts are linked if the Jaccard similarity of their shingle sets is `similarity` or more and their SimHashes are
    within radius bits; null texts and texts without words are linked to each other. Rows with the same id each give a
    row. A null id stands in no component_id unless all ids of its component are null, then that is null. An empty table
    gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    marked = materialize(_nodes(source, shingle, docs.schema[id_col].dataType), "shingle-nodes")
    distinct = marked.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.min("id").alias("least"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "distinct-nodes")
    keyed = distinct.select("node", "n", "fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "n", "fp")).alias("centre"), F.count("*").alias("rows")).where("rows > 1")
    shared = materialize(shared.select("key", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"), F.col("centre.fp").alias("centre_fp")), "shared-keys")
    members = materialize(keyed.join(shared, "key"), "band-members")
    texts = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_hash")
    wanted = source.join(texts, "text_hash").select("node", "text").groupBy("node").agg(F.first("text", True).alias("text"))
    sets = materialize(_sets(wanted, shingle), "shingle-sets")
    release_shuffles(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, n_a, b, n_b), a <> b."""
        asked = pairs.where((F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a"))).select("a", "b")
        both = asked.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("common"))
        return both.where(F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre_fp"))) <= radius
    stars = members.where((F.col("node") != F.col("centre")) & near).select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("centre").alias("b"), F.col("centre_n").alias("n_b")).distinct()
    links = materialize(verified(stars), "star-links")
    roots = materialize(connected_components(links), "star-roots")
    placed = members.join(roots.toDF("node", "root"), "node", "left").join(roots.toDF("centre", "centre_root"), "centre", "left")
    placed = placed.select("key", "fp", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("centre_root", "centre").alias("centre_root"))
    open_ = placed.where("root <> centre_root").select("key").distinct()
    placed = placed.join(materialize(open_, "open-keys"), "key", "left_semi")  # in most keys all are in the centre's component
    rest = materialize(tile_links(placed, sets.join(distinct.select("node", "keys"), "node"), similarity, radius), "other-links")
    roots = connected_components(links.union(rest))
    release_shuffles(spark)
    return marked.join(labels(distinct.select("node", "least"), roots), "node", "left").select("id", "component_id")
