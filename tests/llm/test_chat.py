import random
import time

import duckdb

from tests.llm.data import empty
from vertexloom.llm import chat, oracles, queries

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hi"),
    (1, 2, "bob", "Ho é\U0001f600"),
    (1, 3, "ann", None),
    (1, 4, None, "who"),
    (2, 0, "system", "alone"),
    (None, 1, "cy", "b"),
    (None, 0, "cy", "a"),
    (3, 0, "ann", "same"),
    (3, 0, "ann", "same"),
    (4, None, "dan", "last"),
    (4, 5, "eve", "first"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(turns):
    out = []
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: tuple((x is None, x or "") if not isinstance(x, int) else (False, x) for x in t[1:]))
        for role in sorted({t[2] for t in own if t[2] not in (None, "system")}):
            text, mask = chat.render([(t[2], t[3]) for t in own], role)
            out.append((conv, role, len(own), text, mask))
    return sorted(out, key=str)


def test_every_participant_has_its_view(spark):
    got = [(r["conv_id"], r["perspective"], r["n_turns"], r["text"], [tuple(m) for m in r["mask"]]) for r in chat.rotate(spark.createDataFrame(TURNS, SCHEMA)).collect()]
    assert sorted(got, key=str) == expected(TURNS)


def test_masks_cover_what_the_speaker_says(spark):
    for r in chat.rotate(spark.createDataFrame(TURNS, SCHEMA)).collect():
        said = [r["text"][m["start"] : m["stop"]] for m in r["mask"]]
        assert len(said) == r["n_own"] and all(s.endswith("<|im_end|>") for s in said)
        if (r["conv_id"], r["perspective"]) == (1, "ann"):
            assert said == ["Hi<|im_end|>", "<|im_end|>"]
            assert "<|im_start|>user name=bob\nHo é\U0001f600<|im_end|>" in r["text"] and "<|im_start|>user\nwho" in r["text"]


def test_giant_dialogues_are_cut_but_whole(spark):
    turns = [(9, i // 2, ["ann", "bob", "cy"][i % 3], f"t{i:03d}") for i in range(103)] + [(8, 0, "ann", "x"), (8, 1, "bob", "y")]
    turns += [(None, i, "dan", "z") for i in range(12)]
    df = spark.createDataFrame(turns, SCHEMA).repartition(5)
    out = chat.rotate(df, max_turns=10).collect()
    assert sorted((r["perspective"], r["part"], r["n_turns"]) for r in out if r["conv_id"] == 8) == [("ann", 0, 2), ("bob", 0, 2)]
    for role in ("ann", "bob", "cy"):
        parts = sorted((r for r in out if r["conv_id"] == 9 and r["perspective"] == role), key=lambda r: r["part"])
        assert [p["n_turns"] for p in parts] == [10] * 10 + [3]
        assert "".join(p["text"] for p in parts) == chat.render([(t[2], t[3]) for t in sorted(t for t in turns if t[0] == 9)], role)[0]
    assert sorted((r["part"], r["n_turns"]) for r in out if r["conv_id"] is None) == [(0, 10), (1, 2)]


def test_giant_dialogues_are_whole(spark, tmp_path):
    rng = random.Random(2)
    turns = [(9, i // 2, rng.choice(["ann", "bob", "cy", "system", None]), f"t{i:03d} é\U0001f600") for i in range(203)] + [(8, 0, "ann", "x"), (8, 1, "bob", "y")]
    turns += [(None, i, rng.choice(["dan", "eve"]), rng.choice([None, "z"])) for i in range(31)]
    df = spark.createDataFrame(turns, SCHEMA).repartition(5)
    got = [(r["conv_id"], r["perspective"], r["n_turns"], r["n_own"], r["text"], [tuple(m) for m in r["mask"]]) for r in chat.rotate(df, range_turns=10).collect()]
    assert sorted(((c, p, n, t, m) for c, p, n, _, t, m in got), key=str) == expected(turns)
    assert all(own == len(m) for *_, own, _, m in got)


def test_a_dialogue_of_many_turns_and_speakers(spark):
    turns = spark.range(100_000).selectExpr("1L as conv_id", "id as turn", "concat('s', id % 3) as role", "concat('text ', id) as text")
    turns = turns.union(spark.range(3000).selectExpr("2L", "id", "concat('s', id)", "'x'"))
    began = time.perf_counter()
    sizes = [(r["conv_id"], r["n_turns"], r["chars"]) for r in chat.rotate(turns).selectExpr("conv_id", "n_turns", "length(text) as chars").collect()]
    assert time.perf_counter() - began < 120
    assert [n for c, n, _ in sizes if c == 1] == [100_000] * 3 and [n for c, n, _ in sizes if c == 2] == [3000] * 3000


def test_query_cuts_nothing(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.range(chat.RANGE_TURNS + 5).selectExpr("7L as conv_id", "id as turn", "if(id % 3 = 0, 'ann', 'bob') as role", "concat('t', id) as text").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    assert sorted(con.execute(oracles.OP10).fetchall()) == sorted(map(tuple, queries.op10_chat(spark, str(tmp_path)).collect()))


def test_query_against_oracle(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(TURNS, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    df = queries.op10_chat(spark, str(tmp_path))
    ran = con.execute(oracles.OP10)
    assert [c[0] for c in ran.description] == df.columns
    assert sorted(ran.fetchall(), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_empty_table_and_extra_columns(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "ann", "x", 5, "p")], SCHEMA + ", part int, perspective string")
    assert chat.rotate(df).count() == 1
    assert empty(spark).count() == 0
