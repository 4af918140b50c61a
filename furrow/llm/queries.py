"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from furrow.llm import chunks, extendible, infill, jaccard, langmix, ordinal, pareto, quality, sketches, templates, warc, wavelet, whitening
from furrow.llm.registry import query, table
from furrow.session import written

SHARD_BYTES = 1 << 20


@query("op1_quality_divergence", quality.REPORT_SQL)
def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op2_tokens_wavelet")
def tokens_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded_documents(table(spark, sf_dir, "documents"))


@query("op3_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.held_out_predictions(table(spark, sf_dir, "documents"))


@query("op4_dedup_chunks")
def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents"))


@query("op5_mix_pareto", pareto.MIX_SQL)
def mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.mix_report(table(spark, sf_dir, "documents"))


@query("op6_grade_ordinal")
def grade_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_shard_extendible", extendible.shards_sql(SHARD_BYTES))
def shard_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op8_decontaminate_templates")
def decontaminate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_near_jaccard")
def near_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


@query("op10_warc_derivatives")
def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_report(table(spark, sf_dir, "pages"))


@query("op11_whiten_jacobi_davidson")
def whiten_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


@query("op12_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


@query("op13_infill_frames")
def infill_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = written(infill.pack_texts(table(spark, sf_dir, "documents")), "infill-frames")
    return infill.digests(infill.transformed(store))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
