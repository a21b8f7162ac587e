import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, empty, frame
from vertexloom.llm import queries, sharding


def dealt(df, shards, **kw):
    return [(r["row"]["doc_id"], r["row"]["text"], r["shard"], r["slot"]) for r in sharding.uniform_shards(df, shards, **kw).collect()]


def check(rows, n, shards):
    assert len(rows) == n
    sizes = Counter(r[2] for r in rows)
    assert max(sizes.values(), default=0) - min([sizes.get(s, 0) for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r[3] for r in rows if r[2] == s) == list(range(sizes.get(s, 0)))


@pytest.mark.parametrize("range_rows", [4096, 8])
def test_exact_sizes_and_gapless_slots(spark, range_rows):
    df = frame(spark, [f"t{i}" for i in range(501)]).repartition(7)
    rows = dealt(df, 5, range_rows=range_rows)
    check(rows, 501, 5)
    assert sorted(r[0] for r in rows) == list(range(501))


def test_same_input_same_result(spark, tmp_path):
    frame(spark, [f"t{i}" for i in range(200)]).repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(map(str, dealt(df, 4))) == sorted(map(str, dealt(df, 4)))
    assert sorted(map(str, dealt(df, 4))) != sorted(map(str, dealt(df, 4, seed=8)))


def test_awkward_rows_and_repeats_are_all_kept(spark):
    df = awkward(spark)
    rows = dealt(df, 3)
    check(rows, df.count(), 3)
    assert Counter((r[0], r[1]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_empty_table_and_clashing_columns(spark):
    assert dealt(empty(spark), 3) == []
    df = spark.range(10).selectExpr("id as shard", "id as slot", "id as row", "id as source", "id as at", "id as key")
    assert sorted(r["row"]["shard"] for r in sharding.uniform_shards(df, 3).collect()) == list(range(10))


def test_matrix_sums():
    counts, sizes = [5, 0, 17, 8], [10, 10, 10]
    for seed in range(20):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
        assert min(map(min, m)) >= 0


def test_hypergeometric_law():
    rng, good, bad, draws = random.Random(2), 6, 9, 5
    from math import comb

    n = 20000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(6):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    huge = [sharding.hypergeometric(rng, 10**11, 10**11, 10**6) for _ in range(50)]
    assert abs(sum(huge) / 50 - 5 * 10**5) < 5 * 500 / 50**0.5


def test_places_are_uniform(spark):
    df = frame(spark, ["a"] * 6).coalesce(1)
    seen = Counter(next(r[2] for r in dealt(df, 2, seed=s) if r[0] == 0) for s in range(24))
    assert 4 <= seen[0] <= 20


def test_query(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op7_shards(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r["law"] for r in rows} == {"rows"}
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["size"], by[2]["text_crc32"]) == (8, 0) and by[7]["size"] == 8 + len("ÀÉ Straße 中文".encode())


@pytest.mark.parametrize("range_rows", [4096, 16])
def test_matrix_shuffle_replayed(spark, range_rows):
    """Permute every source, cut it by the matrix, exchange, permute every shard: done once more in plain Python."""
    seed, shards = 7, 4
    df = frame(spark, [f"t{i}" for i in range(157)]).repartition(5, "doc_id")
    keyed = df.select("doc_id", F.spark_partition_id().alias("p"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key")).collect()
    sources = sorted({r["p"] for r in keyed})
    permuted = {p: [r["doc_id"] for r in sorted((r for r in keyed if r["p"] == p), key=lambda r: r["key"])] for p in sources}
    matrix = sharding.communication_matrix([len(permuted[p]) for p in sources], sharding.shard_sizes(157, shards), seed)
    second = {(r["s"], r["r"]): r["key"] for r in spark.range(157).crossJoin(spark.createDataFrame([(p,) for p in sources], "s int")).select("s", F.col("id").alias("r"), F.xxhash64(F.lit(seed + 1), "s", "id").alias("key")).collect()}
    received = {s: [] for s in range(shards)}
    for p, row in zip(sources, matrix, strict=True):
        at = 0
        for s, n in enumerate(row):
            received[s] += [(second[p, rank] % 2**64, permuted[p][rank]) for rank in range(at, at + n)]
            at += n
    bits = max(0, math.ceil(math.log2(max(1, 157 / shards / range_rows))))
    signed = lambda k: k - 2**64 if k >= 2**63 else k
    wanted = {}
    for s, rows in received.items():
        for slot, (_, doc) in enumerate(sorted(rows, key=lambda r: (r[0] >> 64 - bits if bits else 0, signed(r[0])))):
            wanted[doc] = (s, slot)
    assert {r[0]: (r[2], r[3]) for r in dealt(df, shards, range_rows=range_rows)} == wanted


def test_query_against_plain_values(spark, tmp_path):
    df = awkward(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op7_shards(spark, str(tmp_path)).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len(text(r["text"])) + 8, zlib.crc32(text(r["text"]))) for r in df.collect())
    check([(r["doc_id"], None, r["shard"], r["slot"]) for r in rows], df.count(), 24)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_shuffle_is_uniform(spark):
    """Every row lands in every shard about equally often over many seeds."""
    df = frame(spark, [f"t{i}" for i in range(12)]).repartition(3, "doc_id").cache()
    landed = Counter((r[0], r[2]) for seed in range(40) for r in dealt(df, 3, seed=seed))
    expected = 40 / 3
    assert sum((landed[i, s] - expected) ** 2 / expected for i in range(12) for s in range(3)) < 60
