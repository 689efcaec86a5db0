"""Row and column samples keyed on row hashes: the same rows whatever the partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seed


def lowest(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the smallest (score, key), by a threshold rather than a sort of all rows.

    A histogram of the score's leading bits finds the bin where the k-th lies; only that bin is ranked.
    """
    if k <= 0:
        return df.limit(0)
    top = F.shiftright(F.col(score), 51)  # 4096 bins of a 63-bit hash
    counts = {r["b"]: r["n"] for r in df.groupBy(top.alias("b")).agg(F.count("*").alias("n")).collect()}
    before = 0
    for edge in sorted(counts):
        if before + counts[edge] >= k:
            break
        before += counts[edge]
    else:
        return df
    at_edge = df.where(top == edge).orderBy(score, key).limit(k - before)
    return df.where(top < edge).unionByName(at_edge)


def hashed(df: DataFrame, key: str, base: int, stage: str, round_: int = 0, name: str = "_hash") -> DataFrame:
    return df.withColumn(name, seed.row_hash(F.col(key), base, round_, seed.STAGES[stage]))


def carve(df: DataFrame, key: str, fraction: float, base: int) -> tuple[DataFrame, DataFrame]:
    """(rest, held out): the ceil(fraction * n) rows with the lowest hashes, at least 1 and at most n - 1."""
    n = df.count()
    if n < 2:
        raise ValueError("two rows are needed to hold one out")
    held = lowest(hashed(df, key, base, "holdout"), "_hash", key, min(max(math.ceil(fraction * n), 1), n - 1)).drop("_hash")
    return df.join(held.select(key), key, "left_anti"), held


def mvs_sample(df: DataFrame, key: str, g: Column, h: Column, rate: float, base: int, round_: int = 0, least: int = 1) -> DataFrame:
    """The k rows with the largest key ln(u) / sqrt(g^2 + h^2): large gradients are likelier, k is exact."""
    n = df.count()
    k = min(n, max(math.ceil(rate * n), least))
    u = (F.col("_hash") + 1) / F.lit(float(1 << 63))
    keyed = hashed(df, key, base, "rows", round_).withColumn("_pps", F.log(u) / F.sqrt(g * g + h * h))
    return keyed.orderBy(F.col("_pps").desc(), key).limit(k).drop("_hash", "_pps")


def subsample(df: DataFrame, key: str, fraction: float, base: int, bag: int) -> DataFrame:
    """ceil(fraction * n) rows without replacement."""
    n = df.count()
    return lowest(hashed(df, key, base, "bags", bag), "_hash", key, math.ceil(fraction * n)).drop("_hash")


#: Below which uniform number a Poisson(1) count is 0, 1, ... 7; from the last on it is 8.
POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def bootstrap_weights(df: DataFrame, key: str, base: int, bag: int, name: str = "_times") -> DataFrame:
    """Adds how often a bootstrap draws each row, as a Poisson(1) count of its hash. Sums to about n, not to n exactly."""
    u = F.col("_hash") / F.lit(float(1 << 63))
    out = F.lit(len(POISSON_STEPS))
    for k, bound in reversed(list(enumerate(POISSON_STEPS.tolist()))):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return hashed(df, key, base, "bags", bag).withColumn(name, out).drop("_hash")


def sampled_columns(width: int, rate: float, base: int, round_: int) -> list[int]:
    """ceil(rate * width) axes with the lowest hashes."""
    z = seed.mix_seed_array(base, round_, seed.STAGES["columns"], np.arange(width))
    return sorted(np.argsort(z, kind="stable")[: math.ceil(rate * width)].tolist())


def dropped_trees(count: int, rate: float, base: int, round_: int) -> list[int]:
    """Trees that a dropout round leaves out."""
    u = seed.mix_seed_array(base, round_, seed.STAGES["drop"], np.arange(count)).astype(np.float64) / 2**64
    return np.flatnonzero(u < rate).tolist()


def hash_split(df: DataFrame, key: str, parts: int, base: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): every ``parts``-th row goes to test in hash order."""
    n = df.count()
    held = lowest(hashed(df, key, base, "holdout", 1), "_hash", key, max(n // parts, 1)).drop("_hash")
    return df.join(held.select(key), key, "left_anti"), held


def ranked_lowest(df: DataFrame, key: str, k: int, base: int, stage: str) -> DataFrame:
    """The same rows as ``lowest`` by one global rank; for tables of a few rows."""
    order = Window.partitionBy().orderBy("_hash", key)
    return hashed(df, key, base, stage).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_hash", "_n")
