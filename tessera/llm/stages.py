"""Stages of the corpus pipeline: (spark, docs, folder of tables) -> documents, or pieces for the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import keep_identified, train
from .near_dup import near_duplicates
from .packing import pack_documents, special_tokens
from .shared import written
from .substring import drop_repeats

__all__ = ["language_id", "near_dedup", "packing", "substring_dedup", "written"]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if this share of its letters is in one language.
LEAST_SCORE = 0.2
#: Near-duplicates share 80 % of their five-word shingles; passages of at least this many words are repeats.
SHINGLE_WORDS, SIMILAR_PERCENT, PASSAGE_WORDS = 5, 80, 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told: null texts, texts without letters, and jumbles."""
    docs = docs.select(*COLUMNS)
    return keep_identified(docs, train(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the least id. Repeated rows count as copies.

    What is kept is a row of id and text, so rows with null or repeated ids are each judged by their own text; a null
    id comes last, and of rows with the same id one stays. Of rows alike in id and text one stays, whichever, with its
    own other columns. A text without words is a group of its own.
    """
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    groups = near_duplicates(spark, docs.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    named = groups.select(F.col("doc_id").alias("row"), "component_id").distinct().join(docs.select("row", "doc_id").distinct(), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"))
    kept = written(spark, first.select("m.row"))
    return docs.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that occur again out of the texts, every copy of them; a text without any stays as it is."""
    out = drop_repeats(spark, docs, PASSAGE_WORDS, keep_text=True, carry=("lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; the pieces are the pipeline's result."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
