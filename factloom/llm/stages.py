"""The stages of the corpus pipeline: documents in, documents out, each by an operator of this package.

All but encode() return the columns of documents.  Rows without doc_id pass the filters by their scores like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, quality, toxicity
from .common import fresh_name, rested, stored, table

THRESHOLD = 0.7


def rests(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that begins with the driver at rest, whoever calls it: not only run() of the pipeline does."""

    @wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rested(spark)
        return stage(spark, docs, sf_dir)

    return wrapped


def _scored(docs: DataFrame, score: Column, keep: Callable[[Column], Column]) -> DataFrame:
    name = fresh_name(docs, "_score")
    return docs.withColumn(name, score).where(keep(F.col(name))).drop(name)


@rests
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is 0.7 or more.  A null or empty text has the score of an empty one; repeated rows go or stay together; texts are scored whole, and other columns come back as they were."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(F.col("text"), model), lambda s: s < THRESHOLD)


@rests
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose quality score is below 0.7.  A null or empty text has the score of an empty one; repeated rows go or stay together; texts are scored whole, and other columns come back as they were."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(F.col("text"), model), lambda s: s >= THRESHOLD)


@rests
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate group, that of the smallest doc_id; of equal rows of one doc_id and text, one.  Rows without doc_id stay.

    Several texts of one doc_id are judged each by itself: each text of each doc_id gets a vertex of its own then.  An
    empty table stays empty; texts of any length are compared whole, and columns of any name come back as they were.
    """
    columns, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])
    fingerprint = F.coalesce(F.sha2("text", 256), F.lit(""))
    named = docs.where("doc_id IS NOT NULL").select("*", fingerprint.alias("_fp"))
    several = named.groupBy("doc_id").agg(F.min("_fp").alias("lo"), F.max("_fp").alias("hi")).where("lo < hi")
    more = stored(named.select("doc_id", "_fp").join(several, "doc_id").where("_fp > lo").select("doc_id", "_fp").distinct(), "more")
    if more.isEmpty():
        kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
        one = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        vertices = stored(named.select("doc_id", "_fp").distinct().withColumn("_v", F.monotonically_increasing_id()), "vertices")
        texts = named.join(vertices, ["doc_id", "_fp"])
        found = minhash.near_duplicates(texts.select(F.col("_v").alias("doc_id"), "text")).select(F.col("doc_id").alias("_v"), "component_id").distinct()
        names = texts.select("_v", "doc_id", "_fp").distinct()
        kept = found.join(names, "_v").groupBy("component_id").agg(F.min(F.struct("doc_id", "_fp")).alias("x")).select("x.doc_id", "x._fp")
        one = named.join(kept, ["doc_id", "_fp"], "left_semi").dropDuplicates(["doc_id", "_fp"])
    return one.select(docs.columns).union(docs.where("doc_id IS NULL")).toDF(*columns)


@rests
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each full pass of the text's words, rounded to the nearest.

    Documents without words aren't part of a mix by words; the first pass of a document that is cut at the end of its
    source's share counts when at least half of it is taken.  Repeated rows are documents of their own.
    """
    row = fresh_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mixing.mixed(rows, keep=(row,)).where("size > 0")
    times = taken.select(F.col(row).alias("_key"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_times")).where("_times > 0")
    repeated = rows.join(times, rows[row] == times["_key"]).select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times["_times"])).alias(row))
    return repeated.drop(row)


@rests
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) of every document, with proof that they decode to its text: text_sha256 of the decoded bytes.

    Other columns are left out.  Texts of any length are encoded whole; a null text counts as empty.
    """
    import public_tokenizers

    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encoded(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))
