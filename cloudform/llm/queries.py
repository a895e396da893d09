"""One query for each operator, over its whole table and with production parameters; SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, license_scan, line_dedup, merkle, mixing, ngram_join, quality_rules, spelling, suffix_dedup, toxicity, url_filter
from ._base import Scratch
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, url_filter.listed_by_text(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path=path), path=path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    tables = toxicity.fit_toxicity(docs, labels.where(toxicity.fold("doc_id") != 0))
    rows = toxicity.toxicity_scores(docs, tables, own=True)
    return rows.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.stop - x.start)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = Scratch(spark).put(quality_rules.text_statistics(docs), "statistics")
    rows = quality_rules.quality_rules(counts, quality_rules.fit_rules(counts.join(labels, "doc_id")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.extra_turns(spark))
    return chat.chat_digests(chat.format_chat(turns))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelling.spelling_variants(spelling.counted(found))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = merkle.leaf_of([merkle.lowered() if c == "text" else F.col(c) for c in merkle.COLUMNS])
    rows = merkle.merkle_manifest(table(spark, sf_dir, "documents"), claim=claim)
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_url_filter, op3_embedding_dedup, op4_bpe, op5_toxicity, op6_suffix_dedup, op7_license_scan, op8_quality_rules, op9_mix_sources, op10_chat_format, op11_line_dedup, op12_spelling_variants, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
