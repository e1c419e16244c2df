"""A training corpus from documents in five stages, each of one operator; every stage is written and read again.

1. quality: documents that the repetition rules reject go.
2. near_dedup: of each group of near-duplicates (similarity 0.8 or more) the document of smallest id stays.
3. substring_dedup: strings of ``REPEATED`` bytes that also start elsewhere are cut out; what is left of a text stays,
   without the bytes of characters that a cut splits, and n_chars is counted anew. A document of which nothing is left
   goes.
4. mixing: sources are brought to their target weights; a document that the mix takes several times has as many rows.
5. tokens: byte-level BPE ids of every row, and a digest of the text they decode to.

A null text counts as empty: it has no words and goes with the first stage. Rows that repeat a doc_id with its text are
copies of each other, so one of them stays; columns other than doc_id, text and source pass through; no documents give
no rows. ``source`` may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, minhash, mixing, quality, suffix
from colloquy.llm.common import cut, drop_cut, ship, small_batches

#: Shorter than 51 words of ordinary prose (266 bytes and more where passages repeat in the test tables), so that a
#: repeated passage of over 50 words is found whatever its words.
REPEATED = 240
#: Executors have grown by the stages before the last one, so its workers remember and hold less than op2's.
REMEMBERED, BYTES_AT_ONCE = 250_000, 1 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep. A null or empty text has no words and goes."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates. Null, empty and wordless texts are in no group."""
    small_batches(spark)
    return minhash.near_dedup(docs, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED`` bytes that also start elsewhere; a document that they make up goes, one
    whose text is null or empty from the start stays."""
    small_batches(spark)
    done = suffix.remove_repeats(docs, REPEATED, as_text=True)
    text = F.when(F.col("_n_removed") == 0, F.col("text")).otherwise(F.col("_kept"))
    left = done.withColumn("text", text).where("_n_removed = 0 or text <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return left.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document; null is a source of its own, the last one. Texts without words have
    no size and are taken with their block."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text and a digest of what they decode to; a null text is empty. Words may have any length."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(docs, path, public_tokenizers.PATTERN, ("doc_id", "source"), REMEMBERED, BYTES_AT_ONCE)
    return done.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: Signatures, the splitting tree and the merges of a vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        done = cut(stage(spark, docs, sf_dir))
        drop_cut(docs)  # the stage before it, which is read no more
        docs = done
    return docs
