"""The queries of this package, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extraction, langid, lattice, media, minhash, mixing, quality, resampling, sharding, sql, toxicity, trie, warc
from .common import remainder, table

THRESHOLD = 0.7


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), quality.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    found = docs.select("doc_id", held_out, langid.predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.stored_media(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.WIDTH, media.WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages")).where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.slotted(sharding.sharded(docs, "doc_id"), "doc_id", ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_langid": op3_langid,
    "op4_media": op4_media,
    "op5_lattice": op5_lattice,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_extraction": op12_extraction,
    "op13_trie": op13_trie,
}
ORACLES: dict[str, str] = {
    "op2_minhash": sql.OP2_MINHASH,
    "op5_lattice": sql.OP5_LATTICE,
    "op7_warc": sql.OP7_WARC,
    "op11_resampling": sql.OP11_RESAMPLING,
    "op12_extraction": sql.OP12_EXTRACTION,
    "op13_trie": sql.OP13_TRIE,
}
