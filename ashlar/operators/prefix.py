"""Running sums over a global order without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, staged


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each ``name: value`` the sum over all rows up to and including each row in ``order``.

    Rows are dealt by ranges of the order, summed per range, and each range starts from the total of those before it:
    only one row per range meets in one place. Rows that tie in ``order`` are taken one after the other.
    """
    spark = df.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    valued = df.withColumns({f"_v_{n}": v for n, v in sums.items()})
    dealt = staged(valued.repartitionByRange(partitions(spark), *columns).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_range")  # a row per range
    out = out.withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_range", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])
