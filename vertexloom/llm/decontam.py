"""Benchmark decontamination by a distributed positional inverted index, DataFrame functions only.

The training texts are cut into words once (a written table).  Every test window picks its rarest terms
by their frequency over the whole corpus, and the index stores the postings (term, document, position) of
the terms picked; the other lists would never be read.  A phrase is found by intersecting lists adjusted
by their offsets: the rarest term's postings propose alignments, the second rarest's confirm them on
the same diagonal, and a posting of the rarest term carries the words around it, on which the
window is compared word by word.  So nothing but two short lists is shuffled, and no text is read
again.  A proximity match is a stretch of ``span`` words that begins with a word of a window and holds all of its distinct
words, in any order; the rarest term's postings propose these too, and the words around them decide.

Documents are told apart by two hashes of id and text, so null or repeated ids do no harm; rows equal
in both get equal results.  Null and empty texts have no words and aren't contaminated; very long texts are one row of words,
and their postings rows of their own.  Items that repeat, with null texts or without words do no harm either; an
empty table gives an empty result, an empty benchmark hits nothing.  Extra columns are kept by ``clean`` and not read otherwise,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.llm.base import UPPER, id_text, stage

WINDOW, SPAN = 13, 30
#: ASCII signs that part words: all but digits and letters.
SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Rows and bytes (as JSON) of a small side up to which it is broadcast; beyond, Spark joins by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def words_of(text: Column) -> Column:
    """Lower-case words; A-Z alone are lowered, and all characters beyond ASCII belong to words."""
    return F.filter(F.split(F.translate(text, UPPER + SIGNS, UPPER.lower() + " " * len(SIGNS)), " +"), lambda w: w != "")


def tokenised(docs: DataFrame) -> DataFrame:
    """Written table of ``doc_id``, ``k1``, ``k2`` (the row's key), ``n_words`` and ``words``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64(id_text(F.col("doc_id")), text).alias("k1"),
        F.xxhash64(text, id_text(F.col("doc_id")), F.lit("k2")).alias("k2"),
        words_of(text).alias("words"),
    )
    return stage(rows.withColumn("n_words", F.size("words").cast("long")), "decontam-words")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is measured and small."""
    one = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.select(one.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Written table of each item's windows: ``item`` (key), ``item_id``, ``s`` (first word) and ``win``."""
    words = words_of(F.coalesce("text", F.lit("")))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0).distinct()
    items = items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return stage(items.select("item", "item_id", "words", F.explode(starts).alias("s")).select("item", "item_id", "s", F.slice("words", F.col("s") + 1, window).alias("win")), "decontam-windows")


def frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Written table of ``term`` and ``n``, its occurrences in the corpus, for terms that occur."""
    counted = tokens.select(F.explode("words").alias("term")).join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return stage(counted, "decontam-counts")


def postings(tokens: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """The index: ``term``, ``k1``, ``k2``, ``pos``, and where ``terms.wide`` holds the words ``around`` it from ``first`` on."""
    listed = tokens.select("k1", "k2", "words", F.posexplode("words").alias("pos", "term")).join(small(terms), "term")
    first = F.greatest(F.col("pos") - around, F.lit(0))
    return stage(listed.select("term", "k1", "k2", "pos", first.alias("first"), F.when(F.col("wide"), F.slice("words", first + 1, 2 * around + 1)).alias("context")), "decontam-index")


def ranked_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows that can occur, with the terms and item positions of their two rarest words."""
    each = windows.select("item", "s", F.posexplode("win").alias("o", "term")).join(counts, "term", "left")
    best = each.groupBy("item", "s").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") + F.col("o")).alias("at"), "term"))).alias("r"))
    best = best.where("r[0].n > 0").withColumn("r2", F.coalesce(F.try_element_at("r", F.lit(2)), F.col("r")[0]))
    return best.select("item", "s", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["at"].alias("p1"), F.col("r2.term").alias("t2"), F.col("r2.at").alias("p2")).join(windows, ["item", "s"])


@dataclass
class Index:
    """Windows of the benchmark with their rarest terms (``ranked``) and the ``postings`` of these terms."""

    ranked: DataFrame
    postings: DataFrame
    window: int
    span: int


def inverted_index(tokens: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN) -> Index:
    """The positional index that both kinds of matches are read from."""
    windows = windows_of(benchmark, window)
    counts = frequencies(tokens, windows.select(F.explode("win").alias("term")).distinct())
    ranked = stage(ranked_windows(windows, counts), "decontam-ranked")
    terms = ranked.select(F.col("t1").alias("term"), F.lit(True).alias("wide")).union(ranked.select("t2", F.lit(False))).groupBy("term").agg(F.max("wide").alias("wide"))
    return Index(ranked, postings(tokens, terms, max(window, span - 1)), window, span)


def phrase_matches(index: Index) -> DataFrame:
    """``k1``, ``k2``, ``item_id``, ``start`` and ``length`` of every occurrence of a window in a document."""
    ranked, key = index.ranked, ["k1", "k2", "item", "diagonal"]
    rarest = small(ranked.select("item", F.col("t1").alias("term"), F.col("p1")).distinct())
    first = F.greatest(F.col("pos") - index.window, F.lit(0))
    context = F.slice("context", first - F.col("first") + 1, 2 * index.window + 1)
    proposed = index.postings.join(rarest, "term").select("k1", "k2", "item", (F.col("pos") - F.col("p1")).alias("diagonal"), "p1", first.alias("first"), context.alias("context"))
    second = small(ranked.select("item", F.col("t2").alias("term"), F.col("p2")).distinct())
    confirming = index.postings.join(second, "term").select("k1", "k2", "item", (F.col("pos") - F.col("p2")).alias("diagonal"), "p2")
    pairs = small(ranked.select("item", "p1", "p2").distinct())
    agreed = proposed.join(pairs, ["item", "p1"]).join(confirming, [*key, "p2"], "left_semi")
    checked = agreed.join(small(ranked.select("item", "item_id", "s", "win", "p1", "p2")), ["item", "p1", "p2"])
    start = F.col("diagonal") + F.col("s")
    sound = checked.where(start >= F.col("first")).where(F.slice("context", start - F.col("first") + 1, F.size("win")) == F.col("win"))
    return sound.select("k1", "k2", "item_id", start.alias("start"), F.size("win").alias("length")).distinct()


def proximity_matches(index: Index) -> DataFrame:
    """``k1``, ``k2``, ``item_id`` and ``start``: ``span`` words that begin with a word of a window and hold all of its distinct words."""
    chosen = small(index.ranked.select("item_id", F.col("t1").alias("term"), F.array_distinct("win").alias("wanted")).distinct())
    near = index.postings.where("context is not null").join(chosen, "term").where(F.size(F.array_except("wanted", "context")) == 0)
    at = F.col("pos") - F.col("first")
    starts = F.sequence(F.greatest(at - index.span + 1, F.lit(0)), at)
    holds = lambda o: F.array_contains(F.col("wanted"), F.get("context", o)) & (F.size(F.array_except("wanted", F.slice("context", o + 1, F.lit(index.span)))) == 0)
    found = near.select("k1", "k2", "item_id", "first", F.explode(F.filter(starts, holds)).alias("o"))
    return found.select("k1", "k2", "item_id", (F.col("first") + F.col("o")).alias("start")).distinct()


def hits(matches: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``n_hit`` (words inside any occurrence) and ``items`` (sorted ids) of each document hit."""
    spans = matches.select("k1", "k2", "item_id", "start", (F.col("start") + F.col("length")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy("k1", "k2").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    return spans.withColumn("new", new).groupBy("k1", "k2").agg(F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` and ``contaminated`` (a twentieth hit or more) of every row; with ``span`` also
    ``near``, the sorted ids of the items with proximity matches."""
    tokens = tokenised(docs)
    index = inverted_index(tokens, benchmark, window, span or 0)
    found = hits(phrase_matches(index))
    rows = tokens.select("doc_id", "k1", "k2", "n_words").join(found, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    more = []
    if span:
        near = proximity_matches(index).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("near"))
        rows, more = rows.join(near, ["k1", "k2"], "left"), [F.coalesce("near", none).alias("near")]
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "k1", "k2", *more)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged."""
    bad = contamination(docs, benchmark, window).where("contaminated").select("k1", "k2").distinct()
    text, ident = F.coalesce("text", F.lit("")), id_text(F.col("doc_id"))
    same = (F.xxhash64(ident, text) == bad["k1"]) & (F.xxhash64(text, ident, F.lit("k2")) == bad["k2"])
    return docs.join(small(bad), same, "left_anti")
