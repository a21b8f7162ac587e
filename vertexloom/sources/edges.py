"""Edge lists and MatrixMarket files as graphs, and back.

Lines are split by Spark, in parallel and without a Python function.  Ids are integers from 0 to 2^63 - 2; an integer
outside of that raises.  A line that doesn't begin with two integers is skipped, or raises with ``strict``;
``bad_lines`` lists what was skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.graph import MAX_ID, Graph
from vertexloom.plans.staging import discard

WHOLE = "^[+-]?[0-9]+$"


@dataclass
class GraphHeader:
    """The size line of a MatrixMarket file, as declared."""

    rows: int
    columns: int
    entries: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-comment, non-blank lines as ``line`` and ``parts``, with their ``file``, ``block`` and place ``at`` in it."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    trimmed = read.withColumn("line", F.trim(F.regexp_replace("value", r"\s+", " "))).drop("value")
    return trimmed.where("line <> '' and not line like '\\%%' and not line like '#%'").withColumn("parts", F.split("line", " "))


def _is_edge() -> Column:
    word = lambda i: F.coalesce(F.try_element_at("parts", F.lit(i)).rlike(WHOLE), F.lit(False))
    return word(1) & word(2)


def _edges(lines: DataFrame, strict: bool) -> DataFrame:
    """``src``, ``dst`` of lines as words; rows that have them already, where there are such columns, keep them."""
    if "src" not in lines.columns:
        lines = lines.withColumns({"src": F.lit(None).cast("long"), "dst": F.lit(None).cast("long")})
    known, whole = F.col("src").isNotNull(), F.col("src").isNotNull() | _is_edge()
    end = lambda i: F.try_element_at("parts", F.lit(i)).try_cast("long")
    wrong = lambda why: F.raise_error(F.concat(F.lit(why), F.substring("line", 1, 80))).cast("long")
    sound = F.coalesce(end(1).between(0, MAX_ID) & end(2).between(0, MAX_ID), F.lit(False))
    checked = F.when(known, F.col("src")).when(sound, end(1)).when(_is_edge(), wrong("vertex id out of range: ")).otherwise(wrong("not an edge: "))
    rows = lines.where(known | F.col("line").isNotNull() if strict else whole)
    return rows.select(checked.alias("src"), F.when(known, F.col("dst")).otherwise(end(2)).alias("dst"))


def read_edge_list(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """Whitespace-separated pairs; lines that begin with ``%`` or ``#`` are comments, further columns are ignored."""
    # Two integers with one blank between need no pattern; all other lines are looked at word by word.
    first, last = F.substring_index("value", " ", 1), F.substring_index("value", " ", -1)
    a, b = first.try_cast("long"), last.try_cast("long")
    one_blank = F.octet_length(first) + F.octet_length(last) + 1 == F.octet_length("value")
    plain = F.coalesce(one_blank & a.between(0, MAX_ID) & b.between(0, MAX_ID), F.lit(False))
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    comment = (line == "") | line.startswith("%") | line.startswith("#")
    words = F.when(~comment, F.struct(line.alias("line"), F.split(line, " ").alias("parts")))
    # One column says it all, so that a line is looked at once: an edge, words, or nothing.
    nothing = F.lit(None).cast("struct<line:string,parts:array<string>>")
    found = F.when(plain, F.struct(a.alias("src"), b.alias("dst"), nothing.alias("w"))).otherwise(F.struct(F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), words.alias("w")))
    read = spark.read.text(path).select(F.explode(F.array(found)).alias("e")).select("e.*")
    return Graph(_edges(read.select("src", "dst", "w.line", "w.parts"), strict))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` of what a reader that isn't strict skips."""
    return _lines(spark, path).where(~_is_edge()).select("file", "line")


def read_token_stream(spark: SparkSession, path: str) -> Graph:
    """Pairs of integers as one stream per file, whatever the line ends: a pair may begin on one line and end on the next.

    A last token without a partner is no edge.  Tokens are numbered by the counts of the blocks before theirs.
    """
    tokens = _lines(spark, path).select("file", "block", F.col("at"), F.posexplode("parts").alias("i", "token"))
    lines = _lines(spark, path).select("file", "block", "at", F.size("parts").alias("n"))
    blocks = lines.groupBy("file", "block").agg(F.sum("n").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", upto(Window.partitionBy("file").orderBy("block")).alias("start"))
    inside = lines.select("file", "block", "at", upto(Window.partitionBy("file", "block").orderBy("at")).alias("before"))
    placed = tokens.join(inside, ["file", "block", "at"]).join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("before") + F.col("i")).alias("place"), "token")
    pairs = placed.groupBy("file", F.floor(F.col("place") / 2).alias("pair")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("token"))).alias("a"), F.max(F.when(F.col("place") % 2 == 1, F.col("token"))).alias("b"))
    whole = pairs.where("a is not null and b is not null").select(F.concat_ws(" ", "a", "b").alias("line"), F.array("a", "b").alias("parts"))
    return Graph(_edges(whole, strict=True))


def _first_lines(lines: DataFrame) -> DataFrame:
    """The first line of each file that is no comment, after any number of comments."""
    return lines.groupBy("file").agg(F.min(F.struct("block", "at", "line", "parts")).alias("f")).select("file", "f.*")


def _is_size() -> Column:
    return (F.size("parts") == 3) & F.forall("parts", lambda w: w.rlike("^[0-9]+$"))


def read_header(spark: SparkSession, path: str) -> GraphHeader | None:
    """The size line: the first line that is no comment, if it holds three integers."""
    found = _first_lines(_lines(spark, path)).where(_is_size()).orderBy("file").first()
    return GraphHeader(*map(int, found["parts"])) if found else None


def read_matrix_market(spark: SparkSession, path: str, strict: bool = False) -> tuple[Graph, GraphHeader | None]:
    """Entries as edges, ids as they stand (1-based files leave vertex 0 alone); the size line is no edge.

    The size line is the first line that is no comment, if it holds three integers; an entry with the same three
    numbers further on is an edge.  Entries with a value keep their first two columns.
    """
    lines = _lines(spark, path)
    sizes = _first_lines(lines).where(_is_size()).select("file", "block", "at")
    return Graph(_edges(lines.join(sizes, ["file", "block", "at"], "left_anti"), strict)), read_header(spark, path)


def is_matrix_market(spark: SparkSession, path: str) -> bool:
    """By the name, or by the banner in the first line."""
    if path.endswith((".mtx", ".mtx.gz")):
        return True
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0]["value"].startswith("%%MatrixMarket")


def write_edge_list(graph: Graph, path: str) -> None:
    """One ``src dst`` line per edge, in as many files as there are partitions."""
    graph.edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def write_matrix_market(graph: Graph, path: str) -> None:
    """Banner, size line, and one ``src dst`` line per edge, in one file, as the format has it.

    The edges are made and counted in parallel; one task copies them.  It puts the head before its own first line, because
    Spark may read the parts of a union in any order.
    """
    held = graph.staged()
    n, entries = held.size().first()
    head = F.lit(f"%%MatrixMarket matrix coordinate pattern general\n{n} {n} {entries}")
    line = F.concat_ws(" ", "src", "dst")
    if entries:
        copied = held.edges.coalesce(1).withColumn("at", F.monotonically_increasing_id())
        lines = copied.select(F.when(F.col("at") == 0, F.concat_ws("\n", head, line)).otherwise(line).alias("value"))
    else:
        lines = graph.spark.range(0, 1, 1, 1).select(head.alias("value"))
    lines.write.text(path)
    discard(held.edges)


def read_graph(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """``.parquet`` by its src and dst columns, MatrixMarket by name or banner, all else as an edge list."""
    if path.rstrip("/").endswith(".parquet"):
        return Graph.from_edges(spark.read.parquet(path), validate=strict)
    if is_matrix_market(spark, path):
        return read_matrix_market(spark, path, strict)[0]
    return read_edge_list(spark, path, strict)


def sine_wave(spark: SparkSession, n: int) -> DataFrame:
    """``index``, ``value`` = sin(index): the input of the smoke tests."""
    return spark.range(n).select(F.col("id").alias("index"), F.sin(F.col("id").cast("double")).alias("value"))
