"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, codes, lexical, lm, minhash, mixing, quality, rules, suffix, tokenfile, urls
from .common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of the quality rules."""
    rated = quality.rate(_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """What the token files written from all documents hold for each document."""
    folder = f"{shared_folder(spark)}/colloquy-{uuid.uuid4().hex}"
    tokenfile.write(_table(spark, sf_dir, "documents"), folder, path or public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes from each; shards: where each copy goes."""
    drawn = mixing.draw(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("_size") * F.size("_shards")).alias("taken")
    return drawn.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken, F.col("_shards").alias("shards"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all conversations, and one that speaks in control strings, are once formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(chat.text_turns(rows.unionByName(probe))))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every query row of the embeddings."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by rules that the labelled ones teach."""
    return rules.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy differences of all documents; the target are documents labelled good and not toxic."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm.score_exact(_table(spark, sf_dir, "documents"), good)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated strings of 400 bytes are cut out; beyond these columns, the bytes that
    strings of 240 repeated bytes cover, and the text without them."""
    done = suffix.remove_repeats(_table(spark, sf_dir, "documents"), passage=suffix.PASSAGE, columns=["doc_id"])
    digest = [F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256")]
    return done.select("doc_id", *digest, F.col("_n_passage_bytes").alias("n_passage_bytes"), F.col("_n_passages").alias("n_passages"), F.col("_passage_text").alias("text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by codebooks of 64 entries for each of 16 parts."""
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' URLs to allow or block, by rules and else by a regression on n-grams."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
