"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, blockmax, language_id, lattice, line_dedup, mixing, ogg, packing, pii, simhash, spelling, substring_dedup, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.text_media_digest(_docs(spark, sf_dir))


def op2_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_docs(spark, sf_dir))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return pii.span_digest(docs, pii.train(docs))


def op5_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_docs(spark, sf_dir))


def op6_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.train(docs))


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.toxic_scores(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_docs(spark, sf_dir))


def op10_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.ranked(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ogg_media": op1_ogg_media,
        "op2_substring_doubling": op2_substring_doubling,
        "op3_harmonic_packing": op3_harmonic_packing,
        "op4_pii_boosting": op4_pii_boosting,
        "op5_line_alignment": op5_line_alignment,
        "op6_ann_multiprobe": op6_ann_multiprobe,
        "op7_language_ftrl": op7_language_ftrl,
        "op8_toxicity_fm": op8_toxicity_fm,
        "op9_mix_to_weights": op9_mix_to_weights,
        "op10_simhash_pivot": op10_simhash_pivot,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_block_max_search": op12_block_max_search,
        "op13_lattice_near_dedup": op13_lattice_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_mix_to_weights": mixing.ORACLE_SQL,
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_block_max_search": blockmax.ORACLE_SQL,
        "op13_lattice_near_dedup": lattice.ORACLE_SQL,
    }
