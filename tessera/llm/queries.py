"""Queries of this subpackage, one or more an operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import avi, bpe, htmltext, langid, neardup, oracles, packing, pii, quality, secrets, sharding
from .shared import materialise, read_table

#: The vocabulary file of ops 6 and 10.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The key of op 5 in this query; whoever keeps real data private passes one of their own.
KEY = "a key for tables that are made up"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.secret_spans(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("NOT held_out"), "text", "lang", F.col("doc_id"))
    found = langid.labelled_spans(docs.select("doc_id", "held_out", "text"), "text", model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = htmltext.article_texts(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", KEY)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


def op7_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.with_features(docs, "text", F.col("doc_id"), quality.stratum(F.col("lang")).alias("stratum"))
    scored = materialise(scored, "quality")
    labels = read_table(spark, sf_dir, "labels")
    cutoffs = quality.fit_cutoffs(quality.labelled_features(scored, labels))
    return quality.with_verdict(scored, cutoffs).select("doc_id", *quality.FEATURES, "base_failed", "kept", "stratum", *quality.RULES)


def op9_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.film_digests(avi.text_films(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_language_spans, op3_order_minhash, op4_page_differencing, op5_surrogates, op6_best_fit_packing, op7_stratified_interleaving, op8_risk_controlled_quality, op9_avi_motion_jpeg, op10_bpe)}
ORACLE_SQL: dict[str, str] = {"op7_stratified_interleaving": oracles.SHARDS, "op8_risk_controlled_quality": oracles.QUALITY}
