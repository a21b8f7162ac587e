import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import oracles, queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    kept = []
    for i, (vec_id, v, _) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, vec_id, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for i, q, a in kept:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), v) for j, v, b in kept if j != i)
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n, dim, seed=0):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, 0.0, rng.gauss(0, 0.3)]) for _ in range(dim)], 0) for i in range(n)]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", topk.quantised(F.col("embedding")).alias("terms"))
    return sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 20 == 0, **kw).collect()))


def test_against_brute_force_in_blocks(spark):
    rows = vectors(230, 9)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, candidate_block=17, query_block=4) == brute(rows)


def test_ties_repeats_and_bad_vectors(spark):
    same = [0.5, -0.25, 0.0]
    rows = [(i, same, 0) for i in range(45)]
    rows += [(20, same, 0), (100, None, 0), (120, [0.1, None, 0.2], 0), (140, [float("nan"), 0.0, 0.0], 0), (160, [float("inf"), 0.0, 0.0], 0), (None, same, 0), (180, [], 0), (200, [0.5], 0)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, candidate_block=5, query_block=1) == brute(rows)


def test_few_and_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0], 0)]) == []
    assert got(spark, [(0, [1.0], 0), (1, [2.0], 0)]) == [(0, 1, 1, 64 * 128)]


def test_large_weights_need_64_bits(spark):
    rows = [(0, [1e6, 1e6], 0), (1, [1e6, -3.0], 0), (2, [1e6, 1e6], 0)]
    assert got(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_raise_and_large_ones_are_exact(spark):
    rows = [(0, [2.0**40, 2.0**40], 0), (1, [2.0**8, 2.0**7 + 1], 0), (2, [-(2.0**9), 1.0], 0)]
    assert got(spark, rows) == brute(rows)
    for bad in ([3e38, 3e38], [2.0**56, 2.0**56]):
        with pytest.raises(Exception, match="64 bits"):
            got(spark, [(0, bad, 0), (1, bad, 0)])


def test_every_action_and_projection(spark):
    rows = vectors(70, 6, 4)
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", topk.quantised(F.col("embedding")).alias("terms"))
    found, wanted = topk.exact_top_k(df, F.col("vec_id") % 20 == 0), brute(rows)
    assert found.count() == len(wanted) and not found.isEmpty()
    for i, name in enumerate(found.columns):
        assert sorted(r[0] for r in found.select(name).collect()) == sorted(w[i] for w in wanted)
    assert found.agg(F.max("score")).first()[0] == max(w[3] for w in wanted)


def test_narrow_weights_and_clashing_columns(spark):
    for scale in (1.0, 600.0, 1e6):
        rows = [(i, [x * scale for x in v], 0) for i, v, _ in vectors(60, 5, 6)]
        df = spark.createDataFrame(rows, SCHEMA).select("vec_id", topk.quantised(F.col("embedding")).alias("terms"), F.lit(1).alias("at"), F.lit("x").alias("c"), F.lit(0).alias("q"), F.lit(2).alias("score"))
        assert sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 20 == 0, candidate_block=9).collect())) == brute(rows)


def test_oracle(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(vectors(90, 8, 3), SCHEMA).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{path}/*.parquet')")
    assert sorted(con.execute(oracles.OP8).fetchall()) == sorted(map(tuple, queries.op8_top_k(spark, str(tmp_path)).collect()))
