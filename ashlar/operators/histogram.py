"""Histograms of gradients by (leaf, axis, bin): SQL forms, and an Arrow form for the boosting loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_schema

#: Sums of tasks meet as decimals of this scale, so their order does not matter.
DECIMAL = "decimal(38,15)"


def histogram(binned: DataFrame, axes: list[str], g: str = "g", h: str = "h", w: str | None = None, leaf: Column | None = None) -> DataFrame:
    """``leaf, axis, bin, g, h, w, n`` by grouping sets: one pass and one exchange for all axes.

    Sums are made before the exchange, whose rows are at most leaves x axes x bins per task. Bins without rows are absent.
    """
    leaf = F.lit(0) if leaf is None else leaf
    rows = binned.select(leaf.cast("int").alias("leaf"), F.col(g).alias("g"), F.col(h).alias("h"), (F.lit(1.0) if w is None else F.col(w)).alias("w"), F.posexplode(F.array(*axes)).alias("axis", "bin"))
    return rows.groupBy("leaf", "axis", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("w").alias("w"), F.count("*").alias("n"))


def quantized(binned: DataFrame, g: str = "g", h: str = "h", levels: int = (1 << 30) - 1) -> tuple[DataFrame, float, float]:
    """``gq, hq`` as rounded integers of a common scale, and the two scales: integer sums don't depend on their order."""
    row = binned.agg(F.max(F.abs(g)), F.max(F.abs(h))).first()
    gs, hs = (levels / x if x else 1.0 for x in row)
    return binned.withColumns({"gq": F.round(F.col(g) * gs).cast("long"), "hq": F.round(F.col(h) * hs).cast("long")}), gs, hs


def quantized_histogram(binned: DataFrame, axes: list[str], g: str = "g", h: str = "h") -> DataFrame:
    """The histogram from integer sums, scaled back."""
    q, gs, hs = quantized(binned, g, h)
    return histogram(q, axes, "gq", "hq").select("leaf", "axis", "bin", (F.col("g") / gs).alias("g"), (F.col("h") / hs).alias("h"), "w", "n")


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The other child's histogram: what the parent has and this child has not."""
    keys = ["axis", "bin"]
    c = child.select(*keys, *[F.col(x).alias(f"_{x}") for x in ("g", "h", "w", "n")])
    return parent.join(c, keys, "left").select(*keys, *[(F.col(x) - F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in ("g", "h", "w", "n")])


def arrow_histogram(binned: DataFrame, width: int, leaves: int, bins: int, state: Callable[[dict[str, np.ndarray]], tuple], unit: float | None = None) -> np.ndarray:
    """Sums ``[leaf, axis, bin, (g, h, w, n)]`` on the driver: ``arrow_histograms`` of one part with all its columns."""

    def part(batch: dict[str, np.ndarray]) -> tuple:
        columns, *rest = state(batch)
        return dict(enumerate(columns)), *rest

    return arrow_histograms(binned, width, [leaves], bins, [part], unit)[0]


def arrow_histograms(binned: DataFrame, width: int, leaves: list[int], bins: int, states: list[Callable[[dict[str, np.ndarray]], tuple]], unit: float | None = None) -> list[np.ndarray]:
    """Sums ``[leaf, axis, bin, (g, h, w, n)]`` of several parts from one reading of the rows.

    Each of ``states`` turns a batch's columns into (bin columns by axis, leaf, g, h, w), leaf -1 leaving a row out; it holds
    whatever trees the scores need, so no lineage grows. Each task sums its rows in numpy and sends one row per cell; at
    most ``sum(leaves) * width * bins`` come to the driver. With a ``unit``, a bound on |g| and h, gradients are rounded
    to 2**-30 of it: their sums are whole numbers, the same however the rows are dealt.
    """
    grain = None if unit is None else unit / (1 << 30)
    ddl = "cell int, g double, h double, w double, n long"
    schema = arrow_schema(ddl)
    firsts = np.concatenate(([0], np.cumsum(leaves))) * width * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, firsts[-1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            data = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            for first, many, state in zip(firsts, leaves, states, strict=False):
                columns, leaf, g, h, w = state(data)
                used = np.flatnonzero(leaf >= 0)
                leaf, g, h, w = leaf[used], g[used], h[used], w[used]
                if grain is not None:
                    g, h = np.rint(g / grain), np.rint(h / grain)
                size = many * width * bins
                for a, column in columns.items():
                    at = (leaf * width + a) * bins + column[used]
                    for k, value in enumerate((g, h, w, None)):
                        total[k, first : first + size] += np.bincount(at, value, size)
        live = np.flatnonzero(total[3])
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *[pa.array(total[k][live]) for k in range(3)], pa.array(total[3][live].astype(np.int64))], schema=schema)

    sums = binned.mapInArrow(run, ddl).groupBy("cell").agg(*[F.sum(F.col(c).cast(DECIMAL)).cast("double").alias(c) for c in ("g", "h", "w")], F.sum("n").alias("n"))
    table = sums.toArrow()
    out = np.zeros((firsts[-1], 4))
    at = table.column("cell").to_numpy()
    for k, c in enumerate(("g", "h", "w", "n")):
        out[at, k] = table.column(c).to_numpy() * (grain if grain is not None and k < 2 else 1)
    return [out[lo:hi].reshape(-1, width, bins, 4) for lo, hi in zip(firsts[:-1], firsts[1:], strict=True)]
