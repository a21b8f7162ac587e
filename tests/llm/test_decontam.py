import hashlib
import random
import re

import duckdb
import pytest

from tests.llm.data import DOCS, awkward, empty, frame, words
from vertexloom.llm import decontam, oracles, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    out = []
    for text in texts:
        w, hit, found, near = split(text), set(), set(), set()
        for item_id, item in items:
            v = split(item)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item_id))
                wanted = set(v[s : s + n])
                if any(w[p] in wanted and wanted <= set(w[p : p + 30]) for p in range(len(w))):
                    near.add(str(item_id))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return out


def planted(seed=0):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 60))) for i, n in enumerate([40, 25, 13, 12, 5, 1, 30])] + [(7, None), (8, "!?"), (3, "w1 w2 w3")]
    texts = []
    for _ in range(60):
        w = words(rng, rng.choice([0, 5, 60, 300]), 60)
        for _ in range(rng.randrange(3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = v[a : a + rng.choice([3, 14, 40])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    return [*texts, None, "", "...", items[0][1], items[0][1] * 2], items


def tables(spark, path, texts, items):
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_query_against_brute_force_and_oracle(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    texts, items = planted()
    tables(spark, tmp_path, texts, items)
    rows = queries.op4_decontamination(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near"]) for r in rows}
    assert got == dict(enumerate(brute(texts, items)))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ran = con.execute(oracles.OP4)
    names = [c[0] for c in ran.description]
    assert sorted(ran.fetchall()) == sorted(tuple(r[n] for n in names) for r in rows)


def test_awkward_rows_and_repeats(spark):
    df = awkward(spark)
    item = spark.createDataFrame([(1, df.where("doc_id = 0").first()["text"])] * 2, ITEMS)
    rows = decontam.contamination(df, item).collect()
    assert len(rows) == df.count()
    hit = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows if r["contaminated"])
    assert hit == [-1, 0, 0, 0, 1, 10]
    assert {r["n_hit"] for r in rows if r["contaminated"]} == {120}
    kept = decontam.clean(df, item)
    assert kept.columns == df.columns and kept.count() == df.count() - 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contamination(empty(spark), none).count() == 0
    assert not decontam.contamination(frame(spark, ["a b c"]), none).first()["contaminated"]
    assert decontam.contamination(empty(spark), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 3, 4, 5, "x")], "doc_id long, text string, k1 int, pos int, term int, words string")
    assert decontam.clean(df, spark.createDataFrame([(1, "c")], ITEMS)).columns == df.columns


def test_proximity(spark):
    texts = ["alpha x x beta x gamma", "gamma beta alpha", "alpha " + "x " * 40 + "beta gamma", "alpha beta", "x y"]
    tokens = decontam.tokenised(frame(spark, texts))
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha missing")], ITEMS)
    found = decontam.proximity_matches(decontam.inverted_index(tokens, items, span=6)).join(tokens, ["k1", "k2"]).select("doc_id", "item_id", "start")
    assert sorted(map(tuple, found.collect())) == [(0, "1", 0), (1, "1", 0)]


@pytest.mark.parametrize("span", [4, 9, 30])
def test_proximity_against_brute_force(spark, span):
    rng = random.Random(span)
    items = [(i, " ".join(words(rng, n, 9))) for i, n in enumerate([3, 2, 1, 5, 8])]
    texts = [" ".join(words(rng, rng.choice([4, 20, 90]), 12)) for _ in range(50)]
    wanted = set()
    for doc, text in enumerate(texts):
        w = split(text)
        for item_id, item in items:
            v = split(item)
            for s in range(max(1, len(v) - 3)):
                own = set(v[s : s + 4])
                wanted |= {(doc, str(item_id), p) for p in range(len(w)) if w[p] in own and own <= set(w[p : p + span])}
    tokens = decontam.tokenised(frame(spark, texts))
    index = decontam.inverted_index(tokens, spark.createDataFrame(items, ITEMS), window=4, span=span)
    found = decontam.proximity_matches(index).join(tokens, ["k1", "k2"]).select("doc_id", "item_id", "start").collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    df = spark.range(10).selectExpr("repeat('x', 1000) as t")
    assert "broadcast" in decontam.small(df)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 5000)
    assert "broadcast" not in decontam.small(df)._jdf.queryExecution().logical().toString().lower()


def test_documents_schema_is_as_stated():
    assert DOCS.startswith("doc_id long, text string")
