"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_schema, partitions, shared_folder, staged

__all__ = ["WORD", "arrow_schema", "bucketed", "join_spread", "first_of_each", "partitions", "shared_folder", "slices", "staged"]

#: What separates words in every contract of this subpackage; ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task holds the Python objects of few rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` hash buckets of ``key`` and read it back.

    Grouping by ``key`` and joining on it then needs no further shuffle of these rows, however often they are read.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def join_spread(rows: DataFrame, heads: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``heads``, which has one row per ``key`` and in ``n`` how many rows have that key.

    A key with more than a partition's share of the rows is split by the hash ``by``, and its head is repeated for each
    part. There are fewer such keys than shuffle partitions, so they can be broadcast. Pass stored ``heads``.
    """
    parts = partitions(rows.sparkSession)
    share = max(1, -(-(heads.agg(F.sum("n")).first()[0] or 0) // parts))
    pieces = F.ceil(F.col("n") / share).cast("int")
    hot = heads.where(F.col("n") > share).select(key, pieces.alias("_pieces"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_piece", F.pmod(by, F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    repeated = heads.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int, spread: int = 64) -> DataFrame:
    """The first ``most`` rows of each ``key`` in ``order``, numbered in ``_n``.

    Each of ``spread`` parts of a key is cut first, so a key with most of the rows is several tasks, and the last step
    sees at most ``spread * most`` rows of it.
    """
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread)))
    cut = parted.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("_n") <= most)
    return cut.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_part")
