import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.data import awkward, empty, frame, words
from vertexloom.llm import simhash


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, reach=3):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, i in zip(group, ids, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "ÀB\x0bç\x1cd é f g", "x y z " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_print(text)


@pytest.mark.parametrize("leaf", [5, 40, 10**6])
def test_components_against_brute_force(spark, leaf):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        w = words(rng, 80)
        texts.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    rng.shuffle(texts)
    df = frame(spark, texts, 100)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(df, leaf=leaf).collect()}
    prints = [brute_print(t) for t in texts]
    expected = brute_components([100 + i for i in range(len(texts))], prints)
    assert got == {100 + i: (p, c) for i, (p, c) in enumerate(zip(prints, expected, strict=True))}


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)] + [centres]))
    tree, leaves = simhash.grow(points, 4, rng)
    assert leaves > 4
    forest = simhash.Forest(len(points))
    for _, at, home in simhash.place(tree, points, 3):
        simhash.link_within(points, at[home], at[~home], 3, forest, rng)
    close = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    roots = forest.roots(np.arange(len(points)))
    assert (roots[close[:, 0]] == roots[close[:, 1]]).all()
    assert len(set(roots.tolist())) >= 30


def test_pruned_search_equals_plain_one(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 2**12, 900, dtype=np.uint64) * np.uint64(0x0008001000200401))
    every, none = np.arange(len(points)), np.empty(0, np.int64)
    plain, pruned = simhash.Forest(len(points)), simhash.Forest(len(points))
    simhash.link_within(points, every, none, 3, plain, rng)
    monkeypatch.setattr(simhash, "SMALL", 64)
    simhash.link_within(points, every, none, 3, pruned, rng)
    assert (plain.roots(every) == pruned.roots(every)).all()


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[0] == by[1] and by[10] == by[0] and next(iter(by[0]))[1] == 0
    assert by[2] == by[3] == by[4] == {(0, 2)}
    assert {c for _, c in by[None]} == {0, 2}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    only = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.near_duplicates(only).first()["component_id"] is None


def test_one_representative_of_each_group(spark):
    df = awkward(spark)
    kept = sorted(r["doc_id"] for r in simhash.representatives(df).where("doc_id is not null").collect())
    assert 0 in kept and 1 not in kept and 10 not in kept and len(kept) == len(set(kept))
    assert simhash.representatives(df).columns == df.columns


def test_representatives_are_chosen_by_row(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (1, a), (None, c), (None, c), (3, c), (None, "lone words here"), (None, "lone words here"), (4, None), (5, ""), (1, a)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(4)):
        kept = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(df).collect()), key=str)
        assert kept == sorted([(1, a), (1, b), (3, c), (None, "lone words here"), (4, None)], key=str)


def test_representatives_with_clashing_columns(spark, monkeypatch):
    rng = random.Random(9)
    a, b = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    df = spark.createDataFrame([(1, a, 1, 2, 3, "x", "y"), (2, a, 1, 2, 3, "x", "y"), (3, b, 1, 2, 3, "x", "y"), (3, b, 1, 2, 3, "x", "y")], "doc_id long, text string, k1 int, k2 int, key1 int, root string, fp string")
    for limit in (10**6, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
        out = simhash.representatives(df)
        assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_tree_of_a_grown_sample_has_small_leaves():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 2**63, 60000, dtype=np.uint64)
    sample = rng.choice(points, simhash.PER_LEAF * 60, replace=False)
    tree, leaves = simhash.grow(sample, 13, rng, 0, 3, len(sample) // 60)
    sizes = [int(home.sum()) for _, _, home in simhash.place(tree, points, 3)]
    assert leaves >= 60 and sum(sizes) == 60000 and max(sizes) < 1.3 * 1000
