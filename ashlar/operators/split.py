"""Split search over histograms: as a query, and as an arg-max over a small array; leaf values."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seed
from .model import Axis, Split


@dataclass(frozen=True)
class SplitConfig:
    ridge: float = 1.0
    l1: float = 0.0
    max_delta: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 0
    min_hessian: float = 0.0
    min_weight: float = 0.0
    path_smooth: float = 0.0
    monotone: dict[int, int] = field(default_factory=dict)  # axis -> 1 or -1
    groups: tuple[frozenset[int], ...] = ()  # raw features that may meet; none: all may
    cell_budget: int = 0
    budget_power: float = 0.5
    noise: float = 0.0


def soft(g, l1: float):
    """Soft threshold, for arrays."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0) if l1 else g


def step(g, h, c: SplitConfig):
    """Newton step of a cell: thresholded, ridged, clamped."""
    out = -soft(g, c.l1) / np.maximum(h + c.ridge, 1e-300)
    return np.clip(out, -c.max_delta, c.max_delta) if c.max_delta else out


def term(g, h, c: SplitConfig):
    """What a cell takes off the objective at its step, times two."""
    w = step(g, h, c)
    return np.maximum(-2 * soft(g, c.l1) * w - (h + c.ridge) * w * w, 0)


def term_expression(g: Column, h: Column, c: SplitConfig) -> Column:
    s = g if not c.l1 else F.when(g > c.l1, g - c.l1).when(g < -c.l1, g + c.l1).otherwise(F.lit(0.0))
    w = -s / (h + c.ridge)
    if c.max_delta:
        w = F.greatest(F.least(w, F.lit(c.max_delta)), F.lit(-c.max_delta))
    return F.greatest(-2 * s * w - (h + c.ridge) * w * w, F.lit(0.0))


def gain_scan(hist: DataFrame, data_bins: dict[int, int], config: SplitConfig = SplitConfig()) -> DataFrame:
    """``axis, bin_le, missing_left, gain, ok`` of every candidate, from a histogram ``leaf, axis, bin, g, h, w, n``.

    Bins without rows are filled in, since they are candidates too. A candidate's gain sums over all leaves, as one
    test serves them all; ``ok`` says whether every child meets the floors. The histogram's size bounds the windows.
    """
    spark = hist.sparkSession
    axes = spark.createDataFrame([(a, b) for a, b in data_bins.items()], "axis int, nb int")
    cells = hist.select("leaf").distinct().crossJoin(axes).select("leaf", "axis", "nb", F.explode(F.sequence(F.lit(0), F.col("nb"))).alias("bin"))
    full = cells.join(hist, ["leaf", "axis", "bin"], "left").fillna(0, ["g", "h", "w", "n"])
    whole = Window.partitionBy("leaf", "axis")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("g", "h", "w", "n"):
        missing = F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0)).over(whole)
        full = full.withColumns({f"t{c}": F.sum(c).over(whole), f"m{c}": missing, f"l{c}": F.sum(c).over(upto) - missing})
    both = full.where((F.col("bin") >= 1) & (F.col("bin") < F.col("nb"))).withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    side = {c: F.col(f"l{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0) for c in ("g", "h", "w", "n")}
    rest = {c: F.col(f"t{c}") - side[c] for c in side}
    split = (term_expression(side["g"], side["h"], config) + term_expression(rest["g"], rest["h"], config) - term_expression(F.col("tg"), F.col("th"), config)) / 2
    ok = F.lit(True)
    for c, floor in (("n", config.min_rows), ("h", config.min_hessian), ("w", config.min_weight)):
        if floor:
            ok = ok & (side[c] >= floor) & (rest[c] >= floor)
    return both.withColumns({"_gain": split, "_ok": ok}).groupBy("axis", F.col("bin").alias("bin_le"), "missing_left").agg(F.sum("_gain").alias("gain"), F.min("_ok").alias("ok"))


def best_split(scan: DataFrame, config: SplitConfig = SplitConfig(), digits: int = 9) -> DataFrame:
    """The admitted candidate with the largest rounded gain; ties to the lower axis, bin, and missing to the right."""
    ranked = scan.where(F.col("ok") & (F.col("gain") > config.min_gain)).withColumn("gain", F.round("gain", digits))
    return ranked.orderBy(F.col("gain").desc(), "axis", "bin_le", "missing_left").limit(1).select("axis", "bin_le", "missing_left", "gain")


def monotone_ok(values: np.ndarray, splits: list[Split], signs: dict[int, int]) -> np.ndarray:
    """Whether the leaf values, last axis the leaf, follow the order of each constrained level."""
    ok = np.ones(values.shape[:-1], bool)
    for level, split in enumerate(splits):
        sign = signs.get(split.axis, 0)
        if sign:
            low = [leaf for leaf in range(values.shape[-1]) if leaf >> level & 1]
            high = [leaf ^ (1 << level) for leaf in low]
            ok &= (sign * (values[..., high] - values[..., low]) >= -1e-12).all(-1)
    return ok


def find_split(hist: np.ndarray, axes: list[Axis], used: list[Split], config: SplitConfig, columns: list[int], base_seed: int = 0, round_: int = 0) -> tuple[Split, float, np.ndarray] | None:
    """Best candidate of one level over ``hist[leaf, axis, bin, (g, h, w, n)]``, its gain, and the children's sums
    ``[leaf, (high, low), 4]``."""
    taken = {axes[s.axis].raw for s in used}
    best: tuple[float, Split, float] | None = None
    for a in columns:
        axis = axes[a]
        bound = taken | {axis.raw}
        if axis.data_bins < 2 or axis.raw in taken or (config.groups and not any(bound <= g for g in config.groups)):
            continue
        h = hist[:, a, : axis.data_bins + 1]
        total, missing = h.sum(1), h[:, 0]
        left = h[:, 1:].cumsum(1)[:, :-1]
        low = np.stack([left, left + missing[:, None]], 2)  # leaf, bin, missing_left, 4
        high = total[:, None, None] - low
        parent = term(total[:, 0], total[:, 1], config).sum()
        gain = 0.5 * ((term(low[..., 0], low[..., 1], config) + term(high[..., 0], high[..., 1], config)).sum(0) - parent)
        ok = np.isfinite(gain) & (gain > config.min_gain)
        for k, floor in ((3, config.min_rows), (1, config.min_hessian), (2, config.min_weight)):
            if floor:
                ok &= (low[..., k] >= floor).all(0) & (high[..., k] >= floor).all(0)
        if config.monotone:
            values = np.moveaxis(np.concatenate([step(high[..., 0], high[..., 1], config), step(low[..., 0], low[..., 1], config)]), 0, -1)
            ok &= monotone_ok(values, [*used, Split(a, 1)], config.monotone)
        score = np.round(gain, 9)
        if config.cell_budget:
            cells = math.prod(axes[s.axis].data_bins for s in used) * axis.data_bins
            if cells > config.cell_budget:
                score = score * (config.cell_budget / cells) ** config.budget_power
        if config.noise:
            block = (a << 32) + np.arange(gain.size, dtype=np.int64).reshape(gain.shape)
            u = seed.mix_seed_array(base_seed, round_, seed.STAGES["noise"], block).astype(np.float64) / 2**64
            score = score + (u - 0.5) * config.noise / math.sqrt(round_ + 1)
        score = np.where(ok, score, -np.inf)
        at = int(score.argmax())  # the first of equals: lowest bin, missing to the right
        if np.isfinite(score.flat[at]) and (best is None or score.flat[at] > best[0]):
            b, m = np.unravel_index(at, score.shape)
            best = (float(score.flat[at]), Split(a, int(b) + 1, bool(m)), float(gain[b, m]))
    if best is None:
        return None
    split = best[1]
    h = hist[:, split.axis]
    bins = np.arange(h.shape[1])
    low = split.low(bins)
    return split, best[2], np.stack([h[:, ~low].sum(1), h[:, low].sum(1)], 1)


def leaf_values(sums: np.ndarray, config: SplitConfig, splits: list[Split], rate: float = 1.0, history: list[np.ndarray] | None = None) -> np.ndarray:
    """Values of the leaves from their sums ``[leaf, 4]``: monotone clamp, then smoothing towards the parents.

    ``history`` has the sums of each level from the root's, for the parents' values.
    """
    values = clamp_monotone(rate * step(sums[:, 0], sums[:, 1], config), splits, config.monotone)
    if config.path_smooth and history:
        parent = np.zeros(1)
        for level, h in enumerate(history[1:]):
            own = values if level + 2 == len(history) else rate * step(h[:, 0], h[:, 1], config)
            over = parent[np.arange(len(own)) & ((1 << level) - 1)]
            parent = (own * h[:, 3] + over * config.path_smooth) / np.maximum(h[:, 3] + config.path_smooth, 1e-300)
        values = clamp_monotone(parent, splits, config.monotone)
    return values


def clamp_monotone(values: np.ndarray, splits: list[Split], signs: dict[int, int], sweeps: int = 64) -> np.ndarray:
    """Averages the pairs of leaves that break a constraint until none does, or ``sweeps`` are over."""
    values = values.copy()
    for _ in range(sweeps):
        moved = False
        for level, split in enumerate(splits):
            sign = signs.get(split.axis, 0)
            for low in range(len(values)) if sign else ():
                if low >> level & 1:
                    high = low ^ (1 << level)
                    if sign * (values[high] - values[low]) < 0:
                        values[low] = values[high] = (values[low] + values[high]) / 2
                        moved = True
        if not moved:
            break
    return values
