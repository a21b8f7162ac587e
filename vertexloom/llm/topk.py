"""Exact top-k inner-product search: exhaustive term-at-a-time accumulation.

Vectors are read as sparse rows: term t with an integer weight.  Candidates are cut into blocks of
bounded size; a block is an inverted file, one posting list (candidate, weight) per term.  A query
adds its weight times each posting to a dense score array of the block, term after term, and an
exact partition selection leaves the block's best k.  A window merges the blocks.  Queries are cut
into blocks too, and every pair of blocks is one task: neither side is ever held whole.  Weights travel as
the narrowest integers that hold them all.

Rows with a null id, a null vector, or a null or non-finite component take no part.  Vectors of unequal
length are padded with zeros, also very long ones (a block's rows are fewer then).  A row is its own
identity, so repeated rows and repeated ids are separate queries and separate candidates; only the
query's very row is left out.  An empty table, or one without queries, gives an empty result.  Extra
columns are not read, whatever their names.  Scores are exact 64-bit integers: where sums could wrap, a
block is computed in integers of any size, and a weight or a score beyond 64 bits raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.llm.base import again, stage

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 16384
#: Weights of a block at most; blocks of very long vectors have fewer rows.
BLOCK_CELLS = 1 << 24
#: Integer types that weights travel in, with the largest magnitude that each takes.
NARROW = (("smallint", np.int16, 2**15 - 1), ("int", np.int32, 2**31 - 1), ("bigint", np.int64, 2**63 - 1))


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as double; null where the vector takes no part, an error beyond 64 bits."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(as_double, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    beyond = F.raise_error(F.lit("a weight doesn't fit 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale)).otherwise(beyond)
    return F.when(sound, F.transform(as_double, whole))


def _matrix(column: pd.Series, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=dtype)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Postings:
    """The inverted file of one block; lists that cover most of it are kept dense."""

    def __init__(self, weights: np.ndarray, dtype: type) -> None:
        self.size, self.lists = len(weights), []
        for column in weights.T:
            at = np.flatnonzero(column)
            if 2 * len(at) > self.size:
                self.lists.append((None, np.ascontiguousarray(column, dtype=dtype)))
            else:
                self.lists.append((at, column[at].astype(dtype)))
        self.spare = np.empty(self.size, dtype=dtype)

    def accumulate(self, query: np.ndarray, scores: np.ndarray) -> None:
        scores[:] = 0
        for t in np.flatnonzero(query):
            at, weights = self.lists[t]
            if at is None:
                np.multiply(weights, query[t], out=self.spare)
                np.add(scores, self.spare, out=scores)
            elif len(at):
                scores[at] += weights * query[t]


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to the smaller position."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def search_blocks(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, stored: type = np.int64) -> Iterator[tuple]:
    """(query row, query id, candidate id, score) of the best k of one block for each query."""
    candidates = candidates.sort_values(["vec_id", "at"], kind="stable")
    width = max((len(v) for c in (candidates["terms"], queries["terms"]) for v in c), default=0)
    rows, asked = _matrix(candidates["terms"], width, stored), _matrix(queries["terms"], width, stored)
    most = _largest(rows) * _largest(asked) * max(1, width)
    dtype = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    postings, scores = Postings(rows, dtype), np.empty(len(rows), dtype=dtype)
    ids, own = candidates["vec_id"].to_numpy(), {m: i for i, m in enumerate(candidates["at"])}
    for at, vec_id, query in zip(queries["at"], queries["vec_id"], asked, strict=True):
        postings.accumulate(query.astype(dtype), scores)
        best = select(scores, k + 1 if at in own else k)
        best = best[best != own.get(at, -1)]
        exact = scores[best].astype(object if dtype is object else np.int64)
        order = np.lexsort((best, -exact)) if dtype is not object else np.array(sorted(range(len(best)), key=lambda i: (-exact[i], best[i])), dtype=np.int64)
        best, exact = best[order][:k], exact[order][:k]
        if dtype is object and len(exact) and not -(2**63) <= min(exact) <= max(exact) < 2**63:
            raise OverflowError(f"a score of query {vec_id} doesn't fit 64 bits")
        yield at, vec_id, ids[best], exact.astype(np.int64)


def _largest(weights: np.ndarray) -> int:
    """The largest magnitude, as an integer of any size."""
    return max(abs(int(weights.min(initial=0))), int(weights.max(initial=0)))


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of each query's k best other rows.

    ``df`` has ``vec_id`` and ``terms`` (an array of integer weights); ``is_query`` marks the queries.
    Score first, ties to the smaller ``vec_id``.
    """
    rows = df.select(F.col("vec_id").cast("long"), F.col("terms").cast("array<long>"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("at"))
    rows = stage(rows.where("vec_id is not null and terms is not null"), "topk")
    of = lambda f, c: F.coalesce(f(c), F.lit(0))
    n, asks, low, high, width = rows.agg(F.count("*"), F.count_if("asks"), of(F.min, F.array_min("terms")), of(F.max, F.array_max("terms")), of(F.max, F.size("terms"))).first()
    kind, stored_as = next((kind, t) for kind, t, most in NARROW if -most <= low and high <= most or kind == "bigint")
    most_rows = max(1, BLOCK_CELLS // max(1, width))
    blocks, ask_blocks = max(1, math.ceil(n / min(candidate_block, most_rows))), max(1, math.ceil(asks / min(query_block, most_rows)))

    def block(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(count)).cast("int")

    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    terms = F.col("terms").cast(f"array<{kind}>").alias("terms")
    stored = rows.select("vec_id", terms, "at", block(blocks, 1).alias("c"), each(ask_blocks).alias("q"))
    # The table is read again: both sides of a cogroup over one scan share attributes, and pruning would mix them up.
    asked = again(rows).where("asks").select("vec_id", terms, "at", each(blocks).alias("c"), block(ask_blocks, 2).alias("q"))

    def pair(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = list(search_blocks(candidates, queries, k, stored_as)) if len(candidates) and len(queries) else []
        sizes = [len(x[2]) for x in out]
        return pd.DataFrame(
            {
                "at": np.repeat(np.array([x[0] for x in out], dtype=np.int64), sizes),
                "query_id": np.repeat(np.array([x[1] for x in out], dtype=np.int64), sizes),
                "vec_id": np.concatenate([x[2] for x in out] or [np.empty(0, np.int64)]).astype(np.int64),
                "score": np.concatenate([x[3] for x in out] or [np.empty(0, np.int64)]).astype(np.int64),
            }
        )

    found = stored.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInPandas(pair, "at long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
