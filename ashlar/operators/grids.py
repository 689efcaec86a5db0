"""Border grids of numeric columns: midpoints, averaged inverted CDF quantiles, refill, rare-bin collapse."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_schema
from .prefix import running_sums


@dataclass(frozen=True)
class GridConfig:
    max_bin: int = 254
    min_data_per_bin: int = 0
    placement: str = "equal_count"

    def __post_init__(self) -> None:
        if not 2 <= self.max_bin <= 254:
            raise ValueError("max_bin lies between 2 and 254")
        if self.placement != "equal_count":
            raise ValueError("only equal_count borders are implemented")


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite: what borders are made from."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def distinct_values(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """``x, w, n``: the distinct finite values of a column (as float) with their weight and rows."""
    x = F.col(column).cast("float").cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(x.alias("x"), w.alias("w")).where(finite(F.col("x"))).groupBy("x").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def midpoint_borders(distinct: DataFrame) -> DataFrame:
    """``border``: float midpoints of neighbouring distinct values. For few distinct values, as ``max_bin`` allows."""
    following = F.lead("x").over(Window.partitionBy().orderBy("x"))
    return distinct.select(((F.col("x") + following) / 2).cast("float").cast("double").alias("border")).where("border is not null").distinct()


def quantile_borders(distinct: DataFrame, max_bin: int) -> DataFrame:
    """``border``: quantiles k / max_bin as the averaged inverse of the weighted CDF.

    The quantile is the first value whose running weight reaches the share, averaged with the next value where the
    share is met exactly. Running weights are summed by ranges, so no task holds all distinct values.
    """
    running = running_sums(distinct, ["x"], {"cum": F.col("w")})
    total = distinct.agg(F.sum("w")).first()[0] or 0.0
    before = F.col("cum") - F.col("w")
    k_low = F.floor(before * max_bin / total).cast("int")
    hits = F.filter(
        F.sequence(F.greatest(k_low, F.lit(1)), F.greatest(F.ceil(F.col("cum") * max_bin / total).cast("int"), F.greatest(k_low, F.lit(1)))),
        lambda k: (k < max_bin) & (k * total / max_bin <= F.col("cum")) & (k * total / max_bin > before),
    )
    placed = running.select("x", F.explode(hits).alias("k"), (F.col("cum")).alias("cum")).withColumn("exact", F.col("k") * total / max_bin == F.col("cum"))
    plain = placed.where(~F.col("exact")).select(F.col("x").alias("border"))
    at = placed.where("exact").select("x").distinct()
    # at most max_bin - 1 values are met exactly; each looks for the least larger value
    bounds = [r["x"] for r in at.collect()]
    following = {}
    if bounds:
        row = distinct.agg(*[F.min(F.when(F.col("x") > b, F.col("x"))).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
        following = {b: row[i] if row[i] is not None else b for i, b in enumerate(bounds)}
    exact = distinct.sparkSession.createDataFrame([((b + n) / 2,) for b, n in following.items()], "border double")
    return plain.unionByName(exact).select(F.col("border").cast("float").cast("double").alias("border")).distinct()


@dataclass(frozen=True)
class Interval:
    """A run of distinct values ``[start, end)`` with the running weight and rows before it and up to its end."""

    start: float
    end: float
    low: float
    high: float
    first: int
    last: int

    @property
    def mass(self) -> float:
        return self.high - self.low


@dataclass(frozen=True)
class Cut:
    """Where an interval is cut: the border, and the two parts."""

    border: float
    lower: Interval
    upper: Interval


def cut_intervals(running: DataFrame, asked: list[Interval]) -> list[Cut | None]:
    """Each interval's cut at the boundary of values nearest to half its weight, None if it has a single value; one job.

    ``running`` holds distinct values ``x`` with weight ``w``, rows ``n`` and the running sums ``cum`` and ``rows``. The
    row in which an interval's running weight reaches the half lies in the run of one value, whose rows count alike (their
    mean weight each); the run's nearer end in rows is the boundary, the upper one at a tie, and the border is the float
    midpoint of the values beside it. A task sends at most three values per interval: the last below the half and the
    first two from it on.
    """
    order = np.argsort([i.start for i in asked], kind="stable")
    starts, ends = np.array([asked[k].start for k in order]), np.array([asked[k].end for k in order])
    half = np.array([asked[k].low + asked[k].mass * 0.5 for k in order])
    ddl = "k int, above boolean, x double, w double, n long, cum double, rows long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, tuple] = {}
        above: dict[int, list[tuple]] = {}
        for batch in batches:
            x, w, n, cum, rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            k = np.searchsorted(starts, x, side="right") - 1
            inside = np.flatnonzero((k >= 0) & (x < ends[k]))
            inside = inside[np.lexsort((x[inside], k[inside]))]
            for rank, lo, hi in zip(*_runs(k[inside]), strict=True):
                own = inside[lo:hi]
                at = int((cum[own] < half[rank]).sum())
                told = [(x[i], w[i], n[i], cum[i], rows[i]) for i in own[max(at - 1, 0) : at + 2]]
                if at:
                    below[rank] = max(below.get(rank, told[0]), told[0])
                    told = told[1:]
                above[rank] = sorted(above.get(rank, []) + told)[:2]
        found = [(rank, False, *v) for rank, v in below.items()] + [(rank, True, *v) for rank, some in above.items() for v in some]
        columns = zip(*found, strict=True) if found else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array([y.item() if isinstance(y, np.generic) else y for y in c], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    value = F.struct("x", "w", "n", "cum", "rows")
    partial = running.select("x", "w", "n", "cum", "rows").mapInArrow(run, ddl)
    merged = partial.groupBy("k").agg(F.max(F.when(~F.col("above"), value)).alias("below"), F.slice(F.array_sort(F.collect_list(F.when(F.col("above"), value))), 1, 2).alias("above"))
    out: list[Cut | None] = [None] * len(asked)
    for r in merged.collect():
        whole = asked[order[r["k"]]]
        if not r["above"]:
            continue  # the weights add up to less than half only where they are all zero
        at, below, above = r["above"][0], r["below"], r["above"][1] if len(r["above"]) > 1 else None
        if below is None and above is None:
            continue
        each = at["w"] / at["n"]
        before, weight_before = at["rows"] - at["n"], at["cum"] - at["w"]
        reached = before + (math.ceil((whole.low + whole.mass * 0.5 - weight_before) / each) if each > 0 else 0)
        reached = min(max(reached, whole.first + 1), whole.last - 1)
        if above is not None and (below is None or at["rows"] - reached <= reached - before):
            low, high, cum, rows = at["x"], above["x"], at["cum"], at["rows"]
        else:
            low, high, cum, rows = below["x"], at["x"], weight_before, before
        lower = Interval(whole.start, high, whole.low, cum, whole.first, rows)
        upper = Interval(high, whole.end, cum, whole.high, rows, whole.last)
        out[order[r["k"]]] = Cut(float(np.float32((low + high) * 0.5)), lower, upper)
    return out


def _runs(k: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Value, start and end of each run of equal numbers."""
    new = np.flatnonzero(np.diff(k, prepend=-1)) if len(k) else np.zeros(0, np.int64)
    return k[new].tolist(), new.tolist(), [*new[1:].tolist(), len(k)] if len(new) else []


def _whole_intervals(running: DataFrame, borders: list[float]) -> list[Interval]:
    """The intervals between the borders that hold values: a row for each comes to the driver."""
    cuts = F.array(*[F.lit(float(b)) for b in borders]) if borders else F.array().cast("array<double>")
    which = F.size(F.filter(cuts, lambda b: b <= F.col("x")))
    edges = [-math.inf, *borders, math.inf]
    sums = running.groupBy(which.alias("k")).agg(
        F.min(F.col("cum") - F.col("w")).alias("low"), F.max("cum").alias("high"), F.min(F.col("rows") - F.col("n")).alias("first"), F.max("rows").alias("last")
    )
    return [Interval(edges[r["k"]], edges[r["k"] + 1], r["low"], r["high"], r["first"], r["last"]) for r in sums.orderBy("k").collect()]


def refill(borders: np.ndarray, distinct: DataFrame, max_bin: int) -> np.ndarray:
    """Spends what duplicates left of the budget: cuts the heaviest interval near its mass median, again and again.

    ``distinct`` has ``x, w, n``. A part weighs no more than its whole, so the cuts made are those of the heaviest intervals
    of the tree of all cuts. Each wave asks in one job for the cuts of all intervals among the heaviest in sight, the
    parts of those just cut included: as many waves as that tree is deep, about the logarithm of the bins. The driver sees
    a few values per interval, whatever the number of distinct values.
    """
    found = sorted(borders.tolist())
    budget = max_bin - 1 - len(found)
    if budget <= 0:
        return np.array(found)
    running = running_sums(distinct, ["x"], {"cum": F.col("w"), "rows": F.col("n")}).cache()
    try:
        # of equals the one further left goes first, and a whole before its parts
        seen = [(-i.mass, i.start, 0, i) for i in _whole_intervals(running, found)]
        cuts: dict[Interval, Cut | None] = {}
        while True:
            heaviest = [s for s in sorted(seen, key=lambda s: s[:3]) if cuts.get(s[3], True)][:budget]
            asked = [s for s in heaviest if s[3] not in cuts]
            if not asked:
                break
            for (*_, depth, whole), cut in zip(asked, cut_intervals(running, [s[3] for s in asked]), strict=True):
                cuts[whole] = cut
                if cut is not None:
                    seen += [(-part.mass, part.start, depth + 1, part) for part in (cut.lower, cut.upper)]
        return np.unique(found + [cuts[i].border for *_, i in heaviest])
    finally:
        running.unpersist()


def collapse_rare(borders: np.ndarray, x: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Keeps, from left to right, each border that leaves at least ``least`` rows on both its sides."""
    if least <= 0:
        return borders
    total, kept, begun = int(n.sum()), [], 0
    for border in borders:
        upto = int(n[x <= border].sum())
        if upto - begun >= least and total - upto >= least:
            kept.append(border)
            begun = upto
    return np.array(kept)


def build_grid(df: DataFrame, column: str, weight: str | None = None, config: GridConfig = GridConfig()) -> np.ndarray:
    """Strictly ascending borders of a column, at most ``max_bin - 1`` of them; none if nothing is finite.

    The distinct values come to the driver only where there are at most ``max_bin`` of them. Refilling is exact on Spark;
    collapsing counts rows on at most 64 merged values between neighbouring borders, which leaves those counts exact.
    """
    distinct = distinct_values(df, column, weight).cache()
    try:
        few = distinct.limit(config.max_bin + 1).collect()
        if len(few) <= config.max_bin:
            few = sorted(few, key=lambda r: r["x"])
            x, w, n = (np.array([r[c] for r in few], float) for c in ("x", "w", "n"))
            borders = np.unique(((x[:-1] + x[1:]) / 2).astype(np.float32).astype(float)) if len(x) > 1 else np.zeros(0)
        else:
            borders = np.array(sorted(r["border"] for r in quantile_borders(distinct, config.max_bin).collect()))
            x, w, n = summary(distinct, borders) if config.min_data_per_bin else (None, None, None)
        if config.min_data_per_bin:
            return collapse_rare(borders, x, n, config.min_data_per_bin)
        return refill(borders, distinct, config.max_bin)
    finally:
        distinct.unpersist()


def summary(distinct: DataFrame, borders: np.ndarray, per_bin: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, weights and rows of the distinct values, merged to ``per_bin`` per interval; bounded by the grid."""
    cuts = F.array(*[F.lit(float(b)) for b in borders]) if len(borders) else F.array().cast("array<double>")
    bin_ = F.size(F.filter(cuts, lambda b: b < F.col("x")))
    part = F.pmod(F.xxhash64("x"), F.lit(per_bin))
    rows = distinct.groupBy(bin_.alias("bin"), part.alias("part")).agg(F.max("x").alias("x"), F.sum("w").alias("w"), F.sum("n").alias("n")).orderBy("x").collect()
    return tuple(np.array([r[c] for r in rows], float) for c in ("x", "w", "n"))


def bin_expression(x: Column, borders: list[float]) -> Column:
    """Bin of a value as nested cases, for a handful of borders: 0 where missing, else 1 + borders below the value."""
    out = F.when(x.isNull() | F.isnan(x), F.lit(0))
    for k, border in enumerate(borders):
        out = out.when(x <= F.lit(float(border)), F.lit(k + 1))
    return out.otherwise(F.lit(len(borders) + 1)).cast("smallint")


def bins(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The same rule for arrays; NaN is missing."""
    values = values.astype(np.float32).astype(np.float64)
    return np.where(np.isnan(values), 0, np.searchsorted(borders, values, side="left") + 1).astype(np.int16)
