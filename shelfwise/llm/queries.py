"""Registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    exact_topk,
    importance,
    jaccard_join,
    language_id,
    merkle_manifest,
    mixing,
    quality_rules,
    repeated_bytes,
    sampled_segmentation,
    substring_dedup,
    token_alignment,
    token_shards,
    url_filter,
)
from shelfwise.llm.tables import read_table
from shelfwise.staging import new_stage_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
URL_RULES = (
    url_filter.UrlRule("block", "net", "/"),
    url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"),
    url_filter.UrlRule("allow", "org", "/fr/"),
)
URL_GLOBS = (
    url_filter.UrlGlob("block", "**.exe"),
    url_filter.UrlGlob("block", "**/wp-admin/**"),
    url_filter.UrlGlob("block", "*/login*"),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, "url", URL_RULES, URL_GLOBS).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "broken_rules").alias("broken_rules"),
    )


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "mix_tokens", "mix_block", "mix_exponent", "mix_weight", "mix_epochs", "mix_copies"
    )


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")
    )
    model = language_id.train(docs.where(~F.coalesce("held_out", F.lit(False))), language_id.TrainPolicy())
    predicted = language_id.predict(docs.select("doc_id", "held_out", "text"), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_stage_path(spark, "token-shards")
    token_shards.write_shards(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_shards.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(read_table(spark, sf_dir, "documents"))


@query
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_bytes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


@query
def op2_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampled_segmentation.segmentations(docs, public_tokenizers.path(PIECES))


@query
def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read_table(spark, sf_dir, "labels"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that a seventh of the rows present with another length are found out."""
    docs = read_table(spark, sf_dir, "documents").select(*merkle_manifest.COLUMNS)
    # null ids and null lengths stay; the sum leaves the range of long at its end
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = F.when(touched, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars"))
    claim = [more if c == "n_chars" else F.col(c) for c in merkle_manifest.COLUMNS]
    return merkle_manifest.verify(merkle_manifest.build(docs, claim=claim)).drop("proof")


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).drop("kept_text")
