"""SimHash near-duplicates, linked exactly through a vantage-point tree over Hamming distance.

A text's fingerprint has the bits that are set in over half the XXH64 hashes of its 3-word shingles.  All
pairs of distinct fingerprints that differ in ``max_bits`` bits or fewer are links:

* a vantage-point tree is fitted on a sample of fingerprints that grows with the number of leaves; its leaves are shards.
  Of a few vantage points and radii those are taken that cut the fewest balls.  Every fingerprint has one home leaf,
  on its side of each radius;
* the ball of ``max_bits`` around a fingerprint may cross a radius.  By the triangle inequality a leaf
  can hold a partner only where the ball reaches, so the fingerprint also visits those leaves behind
  its home (the pair is found once, at the later home);
* a leaf searches home against home and visitors, pruned by a tree of its own in the same way, down to
  blocks that are compared bit by bit.

Pairs aren't expanded: a leaf returns a spanning forest of its links, and components are joined by
star contraction.  Equal fingerprints are one node, so groups of copies cost nothing.  The sample only
shapes the tree; any tree gives the same links.  In 64 bits the ball of a random fingerprint crosses a
median radius more often than not, so work grows with a power of about 1.7 (README).

Null and empty texts have fingerprint 0 and are linked like any other; texts of any length are hashed whole.  Rows without an
id are linked but never name a component; a component with no id at all has a null id.  Repeated rows share a
component.  An empty table gives an empty result.  Columns beyond doc_id and text aren't read by ``near_duplicates``, and
``representatives`` keeps them all, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from vertexloom.llm.base import discard, free_names, slices, stage, staged_in_batches
from vertexloom.operators.components import star_roots

SHINGLE, SEED = 3, 42
MAX_BITS = 3
#: Rows in a batch that is sent to Python.
BATCH = 1000
#: Distinct fingerprints that a leaf is meant to hold, and of the sample, which grows with the number of leaves: its size at least,
#: and points per leaf.  So a leaf's size is known to a tenth at any number of leaves, and the sample is one in 128 fingerprints at most.
LEAF, SAMPLE, PER_LEAF = 32768, 16384, 256
#: Points that may become a vantage point, and points by which they are judged.
CANDIDATES, JUDGED = 6, 2048
#: Keys of dropped rows up to which their list is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Pairs compared at once, and pairs below which a search isn't pruned further.
BLOCK, SMALL = (256, 2048), 1 << 21
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = 256 * np.arange(8)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each 3-word shingle, repeats included; of the whole sequence if there are fewer words."""
    joined = b" ".join(text.encode().lower().split()) if text else b""
    if not joined:
        return []
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    if len(blanks) < SHINGLE - 1:
        return [xxh64_intdigest(joined, SEED)]
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(joined)]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]  # noqa: B905


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` of every row of ``docs``."""
    return marked(docs.select(F.col("doc_id").cast("long"), "text"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``fp`` in place of their ``text``, which is the last column."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[f.name for f in kept] + ["fp"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


# Trees: a leaf is its number, an inner node (vantage point, radius, near child, far child).


def split_point(sample: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int]:
    """The vantage point and radius, of a few points and the radii that leave a third on either side, that cut the fewest balls."""
    few = sample[rng.choice(len(sample), min(len(sample), JUDGED), replace=False)]
    best = None
    for point in few[rng.choice(len(few), min(len(few), CANDIDATES), replace=False)]:
        counts = np.bincount(np.bitwise_count(few ^ point), minlength=65)
        inside = np.cumsum(counts)
        for radius in range(64):
            if len(few) <= 3 * inside[radius] <= 2 * len(few):
                # Balls around points up to ``reach`` within the radius reach out, and those up to as much beyond reach in.
                cut = inside[min(64, radius + reach)] - (inside[radius - reach] if radius >= reach else 0)
                if best is None or cut < best[0]:
                    best = cut, point, radius
    if best is not None:
        return best[1], best[2]
    point = few[0]
    return point, int(np.median(np.bitwise_count(few ^ point)))


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator, first: int = 0, reach: int = MAX_BITS, leaf: int = 1) -> tuple[object, int]:
    """A tree over ``sample`` and the number of the next leaf; nodes of ``leaf`` sample points or fewer, or at ``depth``, are leaves."""
    if depth == 0 or len(sample) < 2 or len(sample) <= leaf:
        return first, first + 1
    point, radius = split_point(sample, reach, rng)
    near = np.bitwise_count(sample ^ point) <= radius
    if near.all() or not near.any():
        return first, first + 1
    low, nxt = grow(sample[near], depth - 1, rng, first, reach, leaf)
    high, nxt = grow(sample[~near], depth - 1, rng, nxt, reach, leaf)
    return (point, radius, low, high), nxt


def place(tree: object, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions, whether at home) for each leaf: its own points, and visitors from earlier leaves."""

    def walk(node: object, at: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(at):
            return
        if not isinstance(node, tuple):
            yield node, at, home
            return
        point, radius, low, high = node
        away = np.bitwise_count(points[at] ^ point).astype(np.int16)
        near = away <= radius
        go = np.where(home, near, away - reach <= radius)
        yield from walk(low, at[go], home[go])
        go = away + reach > radius
        yield from walk(high, at[go], home[go] & ~near[go])

    yield from walk(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))


class Forest:
    """Union of positions; whole arrays of links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while not np.array_equal(top := self.parent[up], up):
            up = top
        self.parent[at] = up
        return up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, b, a)


def link_within(points: np.ndarray, home: np.ndarray, visitors: np.ndarray, reach: int, forest: Forest, rng: np.random.Generator) -> None:
    """Link all pairs of home x (home + visitors) that are within ``reach``."""
    if len(home) * (len(home) + len(visitors)) > SMALL:
        point = points[home[rng.integers(len(home))]]
        away = np.bitwise_count(points[home] ^ point).astype(np.int16)
        radius = int(np.median(away))
        near = away <= radius
        if not near.all():
            out = np.bitwise_count(points[visitors] ^ point).astype(np.int16)
            link_within(points, home[near], visitors[out - reach <= radius], reach, forest, rng)
            link_within(points, home[~near], np.concatenate((visitors[out + reach > radius], home[near & (away + reach > radius)])), reach, forest, rng)
            return
    both = np.concatenate((home, visitors))
    x, y = points[home], points[both]
    for i in range(0, len(x), BLOCK[0]):
        row = x[i : i + BLOCK[0], None]
        for j in range(i, len(y), BLOCK[1]):  # pairs of two at home are met once
            a, b = np.nonzero(np.bitwise_count(row ^ y[None, j : j + BLOCK[1]]) <= reach)
            a, b = home[i + a], both[j + b]
            forest.link(a[a != b], b[a != b])


def links(distinct: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF, seed: int = 5) -> DataFrame:
    """A spanning forest (u, v) of all links between the distinct fingerprints ``fp``."""
    n = distinct.count()
    leaves = max(1, n / leaf)
    size = max(SAMPLE, PER_LEAF * math.ceil(leaves))
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()] if leaves > 1 else []
    # A side may keep two thirds: nodes are split until the sample says that a leaf is small enough.
    tree, _ = grow(np.array(sample, dtype=np.int64).view(np.uint64), 2 * math.ceil(math.log2(leaves)) + 1, np.random.default_rng(seed), 0, max_bits, max(1, int(len(sample) / leaves)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, at, home in place(tree, points, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, dtype=np.int32)), pa.array(points[at].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        points, home = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
        forest = Forest(len(points))
        link_within(points, np.flatnonzero(home), np.flatnonzero(~home), max_bits, forest, np.random.default_rng(seed))
        everyone = np.arange(len(points))
        top = forest.roots(everyone)
        linked = top != everyone
        return pd.DataFrame({"u": points[linked].view(np.int64), "v": points[top[linked]].view(np.int64)})

    return distinct.mapInArrow(deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInPandas(search, "u long, v long")


def classes_of(found: DataFrame, max_bits: int, leaf: int) -> DataFrame:
    """Written table of ``fp``, ``root`` (a fingerprint that names its component) and ``component_id``, of the rows ``found``."""
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = stage(star_roots(links(classes.select("fp"), max_bits, leaf)), "simhash-roots")
    nodes = roots.union(roots.select("root", "root").distinct())
    linked = nodes.join(classes, nodes["node"] == classes["fp"]).select("fp", "root", "first")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "root", "least")
    final = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    # Written, so that a join stands on two plain exchanges and a hot fingerprint's partition can be split.
    written = stage(final, "simhash-components")
    discard(classes)
    discard(roots)
    return written


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest reachable doc_id) of every row of ``docs``."""
    found = staged_in_batches(fingerprints(docs), "simhash", BATCH)
    return found.join(classes_of(found, max_bits, leaf), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null last), then the smallest hash of the row.

    Rows are told apart by a 128-bit key over all their columns (those that Spark can hash), not by their id: rows that
    share an id but not their text are judged each on its own.  Of rows equal throughout one stays.
    """
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    k1, k2 = F.xxhash64(*hashable), F.xxhash64(F.lit("second"), *hashable)
    found = staged_in_batches(marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")), "simhash", BATCH)
    rooted = stage(found.join(classes_of(found, max_bits, leaf), "fp").select("root", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2"), "simhash-rows")
    # One row of each component: the least; its key may stand for several equal rows.
    best = rooted.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", "k1", "k2")).alias("b"), F.count("*").alias("n"))
    best = stage(best.where("n > 1").select("root", "b.k1", "b.k2"), "simhash-best")
    judged = rooted.join(best.withColumnsRenamed({"k1": "b1", "k2": "b2"}), "root")
    gone = judged.where("k1 <> b1 or k2 <> b2").select("k1", "k2").distinct()
    repeats = judged.where("k1 = b1 and k2 = b2").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    gone, repeats = stage(gone, "simhash-gone"), stage(repeats, "simhash-repeats")

    key = free_names(docs, "key1", "key2")

    def listed(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]))
        return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys

    keyed = docs.withColumns({key[0]: k1, key[1]: k2}).join(listed(gone), key, "left_anti")
    if not repeats.isEmpty():
        several = listed(repeats)
        once = keyed.join(several, key, "left_semi").dropDuplicates(key)
        keyed = keyed.join(several, key, "left_anti").unionByName(once)
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns])
