"""Chat formatting: multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once with that participant as the
assistant and all others as named users; the mask spans cover what the participant says, so that a
loss is taken on these words alone.  ``system`` turns speak for nobody: they are rendered as system
and never learnt.  Turns are ordered by (turn, role, text), nulls last.

A dialogue is one row per participant, however long it is.  Dialogues of up to ``range_turns`` turns are
rendered by the task that holds their turns, one perspective after the other.  Longer ones are cut into
ranges that are rendered apart, and the renderings of the ranges are joined in order, with their mask spans
moved by what comes before; so a giant dialogue is spread over many tasks and the only thing held whole is
a finished row.  ``max_turns`` (off by default) leaves a dialogue in parts of that many turns instead, for models
of a bounded context; every turn is in exactly one part, and ``part`` counts them from 0.

Turns with a null role are users without a name; a null text is an empty message; rows with a null
conversation id make one dialogue; repeated rows are repeated turns.  A dialogue without participants gives no
row, an empty table an empty result.  Any number of speakers is rendered, one row each: the output is turns
times speakers, by definition.  Columns beyond the four named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.llm.base import stage

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"
SCHEMA = "conv_id string, perspective string, part int, n_turns int, n_own int, text string, mask array<struct<start:int,stop:int>>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
RANGE_TURNS = 4096
#: Characters of renderings that a task hands on at once, and rows.
HANDED_CHARACTERS, HANDED_ROWS = 1 << 23, 2000


def render(turns: Iterable[tuple[str | None, str | None]], perspective: str) -> tuple[str, list[tuple[int, int]]]:
    """The dialogue as ``perspective`` lives it, and the half-open character spans to learn."""
    out, at, mask = [], 0, []
    for role, text in turns:
        body = text or ""
        if role == perspective:
            head = f"{START}assistant\n"
            mask.append((at + len(head), at + len(head) + len(body) + len(END) - 1))
        elif role == SYSTEM:
            head = f"{START}system\n"
        else:
            head = f"{START}user" + (f" name={role}" if role is not None else "") + "\n"
        piece = f"{head}{body}{END}"
        out.append(piece)
        at += len(piece)
    return "".join(out), mask


def _handed(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """The rows in frames of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5])
        if size >= HANDED_CHARACTERS or len(held) >= HANDED_ROWS:
            yield pd.DataFrame(held, columns=NAMES)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=NAMES)


def _rotations(batches: Iterator[pd.DataFrame], with_part: bool) -> Iterator[tuple]:
    """One row per perspective of each run of rows with one key; ``roles`` are the dialogue's where they are given."""
    key, held, roles = None, [], None

    def flush() -> Iterator[tuple]:
        everyone = sorted({r for r, _ in held if r is not None and r != SYSTEM}) if roles is None else roles
        for role in everyone:
            text, mask = render(held, role)
            yield key[0], role, key[1], len(held), len(mask), text, [{"start": a, "stop": b} for a, b in mask]

    for batch in batches:
        parts = batch["part"] if with_part else [0] * len(batch)
        people = batch["roles"] if with_part else [None] * len(batch)
        for conv, part, role, text, all_roles in zip(batch["conv_id"], parts, batch["role"], batch["text"], people, strict=True):
            if held and (conv, part) != key:
                yield from flush()
                held = []
            key, roles = (conv, part), all_roles
            held.append((role, text))
    if held:
        yield from flush()


def rotate(turns: DataFrame, max_turns: int | None = None, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per dialogue (with ``max_turns``: per part of one) and participant; see the module for the rules.

    ``turns`` has conv_id, turn, role and text.
    """
    rows = turns.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text")]
    size = range_turns if max_turns is None else max_turns

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _handed(_rotations(batches, with_part=False))

    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > size)
    typed = F.col("conv_id").cast(turns.schema["conv_id"].dataType)
    if sizes.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(whole, SCHEMA).withColumn("conv_id", typed)
    sizes = stage(sizes, "chat-giants")
    giant = rows.join(sizes.select("conv_id"), rows["conv_id"].eqNullSafe(sizes["conv_id"]), "left_semi")
    rest = rows.join(sizes.select("conv_id"), rows["conv_id"].eqNullSafe(sizes["conv_id"]), "left_anti")
    ordinary = rest.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(whole, SCHEMA)
    parts = rendered_ranges(giant, size)
    return ordinary.unionByName(joined(parts) if max_turns is None else parts).withColumn("conv_id", typed)


def rendered_ranges(rows: DataFrame, size: int) -> DataFrame:
    """Every ``size`` turns of each dialogue as a part, rendered for each participant of the dialogue, also silent ones.

    Rows are range-sorted and numbered by (range, place in it).
    """
    columns = ["conv_id", "turn", "role", "text"]
    nulls_last = [F.asc_nulls_last(c) for c in columns]
    ordered = rows.repartitionByRange(*nulls_last).sortWithinPartitions(*nulls_last)
    placed = stage(ordered.select(*columns, F.monotonically_increasing_id().alias("at")), "chat-giant").withColumn("range", F.shiftright("at", 33))
    # Several dialogues may share a range, and one may fill many: offsets come from counts and first places.
    spans = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "range", "first", before.alias("before"))
    at = F.col("p.at") - F.col("s.first") + F.col("s.before")
    numbered = placed.alias("p").join(spans.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.range") == F.col("s.range")))
    numbered = numbered.select("p.conv_id", "p.role", "p.text", at.alias("number"), F.floor(at / size).cast("int").alias("part"))
    people = placed.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    told = numbered.alias("n").join(people.alias("r"), F.col("n.conv_id").eqNullSafe(F.col("r.conv_id"))).select("n.*", "r.roles")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _handed(_rotations(batches, with_part=True))

    return told.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "number").mapInPandas(apart, SCHEMA)


def joined(parts: DataFrame) -> DataFrame:
    """The parts of each dialogue and perspective as one row; only finished rows are held whole."""
    lengths = F.struct("part", "n_turns", "n_own", F.char_length("text").alias("length"), "text", "mask")
    gathered = parts.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(lengths)).alias("p"))
    # Spans move by the length of the parts before theirs.
    moved = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["length"]).alias("at"),
            F.concat(acc["spans"], F.array(F.transform(x["mask"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop"))))).alias("spans"),
        ),
        lambda acc: F.flatten(acc["spans"]),
    )
    added = lambda c: F.aggregate("p", F.lit(0), lambda acc, x: acc + x[c]).alias(c)
    return gathered.select("conv_id", "perspective", F.lit(0).alias("part"), added("n_turns"), added("n_own"), F.array_join("p.text", "").alias("text"), moved.alias("mask"))
