"""The registered queries of this subpackage: (spark, folder of tables) -> rows, and SQL where it can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fixity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import edited_copies, pictures

    # Drawing and describing take far longer than reading, so the few splits of a small table are dealt to all cores.
    vectors = table(spark, sf_dir, "embeddings").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return edited_copies(spark, pictures(vectors))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixity import archive, audit, damaged

    pages = table(spark, sf_dir, "pages")
    return audit(spark, archive(pages), damaged(pages))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents, special_tokens

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import drop_repeats

    return drop_repeats(spark, table(spark, sf_dir, "documents"), 35)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_content import default_model, main_text

    return main_text(table(spark, sf_dir, "pages"), default_model())


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {
    "op1_image_copies": op1_image_copies,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_token_counts": op3_token_counts,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_byte_bpe": op10_byte_bpe,
}

SQL: dict[str, str] = {"op2_warc_fixity": fixity.SQL}
