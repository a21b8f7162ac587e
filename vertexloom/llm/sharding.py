"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Sanders' scheme for distributed random permutation:

1. every source partition permutes its rows (a local sort by a seeded hash);
2. the number of rows that source p sends to shard s is drawn, for all p and s, from the law a uniform
   permutation would give: multivariate hypergeometric, row by row, given the shard sizes;
3. source p sends the first m[p, 0] of its permuted rows to shard 0, the next m[p, 1] to shard 1, ...;
4. every shard permutes what it got.

Only the counts of the sources reach the driver.  Their number is bounded: at most ``MAX_CELLS`` cells
of the matrix, so that it may be broadcast (16 MB).  A shard is no unit of work: it is cut by the
second hash into ranges of about ``range_rows`` rows, and a slot is the range's offset plus the
rank in it, so a shard of terabytes is spread over many tasks.

Nulls, repeated rows and clashing column names are carried through: a row's place is its identity.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.llm.base import packed, stage

MAX_CELLS = 1 << 21
ROW_MASK = (1 << 33) - 1


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw: the number of good ones among ``draws`` of ``good + bad``, at any size.

    The pmf is followed outwards from its mode by the ratio of neighbours, so no factorial loses digits.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    sd = math.sqrt(max(1.0, draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1)))
    first, last = max(low, mode - int(12 * sd) - 30), min(high, mode + int(12 * sd) + 30)
    k = np.arange(first, last, dtype=np.float64)
    with np.errstate(divide="ignore"):
        step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    cdf = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right").clip(0, last - first))


def shard_sizes(n: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: sources; columns: shards.  Row sums are ``counts``, column sums are ``sizes``."""
    rng, left, matrix = random.Random(seed), list(sizes), []
    for n in counts:
        row, draws, pool = [], n, sum(left)
        for s, room in enumerate(left):
            got = draws if s == len(left) - 1 else hypergeometric(rng, room, pool - room, draws)
            row.append(got)
            pool -= room
            draws -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def uniform_shards(df: DataFrame, shards: int, seed: int = 7, range_rows: int = 4096) -> DataFrame:
    """``row`` (a struct of all columns of ``df``), ``shard`` int and ``slot`` long, gapless from 0.

    Every assignment of rows to (shard, slot) is equally likely up to the quality of the hash; the
    counts of two shards differ by one at most.  The same input files and seed give the same result.
    """
    spark = df.sparkSession
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = packed(df).coalesce(max(1, MAX_CELLS // shards))  # fewer sources only if there are more
    local = (
        rows.withColumn("key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
        .sortWithinPartitions("key")
        .select("row", F.monotonically_increasing_id().alias("at"))
    )
    local = stage(local, "sharding").select("row", F.shiftright("at", 33).cast("int").alias("source"), F.col("at").bitwiseAND(ROW_MASK).alias("rank"))
    counts = {r["source"]: r["count"] for r in local.groupBy("source").count().collect()}
    sources = sorted(counts)
    matrix = communication_matrix([counts[p] for p in sources], shard_sizes(sum(counts.values()), shards), seed)
    cuts = spark.createDataFrame([(p, np.cumsum(m).tolist()) for p, m in zip(sources, matrix, strict=True)], "source int, cuts array<long>")
    bits = max(0, math.ceil(math.log2(max(1, sum(counts.values()) / shards / range_rows))))
    dealt = local.join(F.broadcast(cuts), "source").select(
        "row",
        F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "source", "rank").alias("key"),
        "source",
        "rank",
    )
    part = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = dealt.withColumn("part", part)
    slots = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "source", "rank")).cast("long") - 1
    if not bits:
        return dealt.select("row", "shard", slots.alias("slot"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("shard", "part").count().select("shard", "part", before.alias("before"))
    if shards << bits <= MAX_CELLS // 4:
        offsets = F.broadcast(offsets)
    return dealt.withColumn("slot", slots).join(offsets, ["shard", "part"]).select("row", "shard", (F.col("slot") + F.col("before")).alias("slot"))
