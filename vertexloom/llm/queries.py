"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import chat, decontam, langid, pieces, quality, sharding, simhash, substrings, topk, warc
from vertexloom.llm.base import crc_mod, table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs.select("doc_id", "held_out", "text"), quality.fit(docs.where("not held_out"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=decontam.SPAN)
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs, usable=~F.col("held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages"))
    # These archives are whole: a gap would be a page too few, so it is an error.
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in a new archive: "), "gap")).cast("long")
    return read.withColumn("page_id", F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(lost)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(table(spark, sf_dir, "documents"), 24)
    text = F.coalesce("row.text", F.lit("")).cast("binary")
    return dealt.select(
        "row.doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("terms"))
    return topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip")
    return coded.select("doc_id", F.size("pieces").alias("n_pieces"), "round_trip", "pieces")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    return rotated.withColumn("mask", spans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_substrings, op2_quality, op3_simhash, op4_decontamination, op5_language, op6_warc, op7_shards, op8_top_k, op9_pieces, op10_chat]
    return {f.__name__: f for f in named}
