"""The seed mixer that every row-hash operator keys on, for Python, numpy, Arrow batches and SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = (1 << 64) - 1
# The mixer's odd multipliers for round, stage and block, and those of its finaliser.
ROUND, STAGE, BLOCK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Stages of the mixer by use.
STAGES = {"grid": 1, "rows": 2, "columns": 3, "quantize": 4, "folds": 5, "holdout": 6, "bags": 7, "drop": 8, "noise": 9}


def mix_seed(base: int, round_: int, stage: int, block: int) -> int:
    """64-bit seed of a (round, stage, block) under ``base``."""
    z = base ^ (round_ * ROUND & _ALL) ^ (stage * STAGE & _ALL) ^ (block * BLOCK & _ALL)
    z = (z ^ (z >> 30)) * MIX_A & _ALL
    z = (z ^ (z >> 27)) * MIX_B & _ALL
    return z ^ (z >> 31)


def mix_seed_array(base: int, round_: int, stage: int, block: np.ndarray) -> np.ndarray:
    """``mix_seed`` of many blocks at once, as uint64."""
    u = np.uint64
    z = u(base ^ (round_ * ROUND & _ALL) ^ (stage * STAGE & _ALL)) ^ (np.asarray(block).astype(np.int64).view(u) * u(BLOCK))
    z = (z ^ (z >> u(30))) * u(MIX_A)
    z = (z ^ (z >> u(27))) * u(MIX_B)
    return z ^ (z >> u(31))


def row_hash(key: Column, base: int, round_: int, stage: int, modulus: int | None = None) -> Column:
    """Hash of a row's integer key: its remainder by ``modulus``, or without one its top 63 bits, which fit a long.

    A null key has a null hash and leaves the others alone: they never pass through floating point.
    """

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            z = mix_seed_array(base, round_, stage, keys.to_numpy())
            out = z >> np.uint64(1) if modulus is None else z % np.uint64(modulus)
            yield pd.Series(out.astype(np.int64))

    # a single null would turn a whole batch of keys into doubles, so nulls stay outside
    return F.when(key.isNotNull(), hashed(F.coalesce(key.cast("long"), F.lit(0))))


def row_hash_sql(key: str, base: int, round_: int, stage: int, modulus: int | None = None) -> str:
    """The same hash as a DuckDB expression over a non-negative key."""
    start = base ^ (round_ * ROUND & _ALL) ^ (stage * STAGE & _ALL)

    def times(z: str, odd: int) -> str:
        return f"((({z})::UHUGEINT * {odd}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    z = f"xor({start}::UBIGINT, {times(f'({key})::UBIGINT', BLOCK)})"
    for shift, odd in ((30, MIX_A), (27, MIX_B)):
        z = f"list_transform([{z}], lambda z: {times(f'xor(z, z >> {shift})', odd)})[1]"
    z = f"list_transform([{z}], lambda z: xor(z, z >> 31))[1]"
    return f"(({z}) >> 1)::BIGINT" if modulus is None else f"(({z}) % {modulus}::UBIGINT)::BIGINT"
