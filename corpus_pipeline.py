"""A corpus pipeline: toxicity, line deduplication, near-duplicates, mixing, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns the columns of ``documents``; the last one returns packed pieces. Null, empty, repeated and tied rows, rows without
an id, empty tables and further columns pass as the stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ashlar.llm import line_dedup, mixing, packing, shingles, toxicity
from ashlar.llm.common import staged


#: Texts may be long, so tasks exchange so many rows at a time with Python at most.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, which hold whole texts on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; all others stay as they are."""
    _small_batches(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks of lines go from the later document; every document stays."""
    _small_batches(spark)
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word shingle similarity of 0.8 or more stays."""
    _small_batches(spark)
    return shingles.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the repetitions that bring each source to its target."""
    _small_batches(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the trained machine nor the alignment, fingerprints and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
