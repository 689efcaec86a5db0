"""After the fit: a correction on table cells, bags with corrections, and ensembles selected from a library of fits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seed
from ..functions.losses import loss_by_name
from ..session import arrow_schema, staged
from . import ridge
from .boost import BoostConfig, Booster, Member, greedy_average, in_bag
from .histogram import DECIMAL
from .model import Axis, Correction, InvalidParameter, Model

#: Most cells per axis of a pair's correction, and most rows of the selection sample.
PAIR_CELLS, SELECT_ROWS = 24, 20_000
SHRINKS = (0.0, 0.25, 0.5, 0.75, 1.0)


def coarse_map(data_bins: int, most: int) -> np.ndarray:
    """Coarse cell of each bin: 0 stays missing, data bins fall into at most ``most - 1`` equal runs."""
    cells = min(data_bins, most - 1)
    return np.concatenate(([0], 1 + np.arange(data_bins) * cells // data_bins)).astype(np.int64)


def supports_of(model: Model) -> list[tuple[int, ...]]:
    """Axes sets of one or two that the model's trees use, ascending."""
    out: set[tuple[int, ...]] = set()
    for _, tree in model.trees:
        axes = sorted(s.axis for s in tree.splits)
        out.update((a,) for a in axes)
        out.update((a, b) for i, a in enumerate(axes) for b in axes[i + 1 :])
    return sorted(out, key=lambda u: (len(u), u))


def _layout(model: Model, supports: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], list[np.ndarray], int, int]]:
    """Per support its axes, coarse maps, first column and number of columns."""
    out, at = [], 0
    for u in supports:
        maps = [coarse_map(model.axes[a].data_bins, 255 if len(u) == 1 else PAIR_CELLS) for a in u]
        size = int(np.prod([m.max() + 1 for m in maps]))
        out.append((u, maps, at, size))
        at += size
    return out


def _column(maps: list[np.ndarray], bins: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(bins[0]), np.int64)
    for m, b in zip(maps, bins, strict=True):
        out = out * (m.max() + 1) + m[b]
    return out


def out_of_bag(models: list[Model], members: list[Member], data: dict[str, np.ndarray], bins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's mean raw score over the bags that did not draw it, without offset, and in how many it was left out."""
    total, count = np.zeros(len(data["rid"])), np.zeros(len(data["rid"]), np.int64)
    for model, member in zip(models, members, strict=True):
        out = ~in_bag(data["rid"], member.bound)
        if out.any():
            total[out] += model.raw_score([b[out] for b in bins])
            count[out] += 1
    return total / np.maximum(count, 1), count


def cell_correction(
    binned: DataFrame, model: Model, base: float = 10.0, gamma: float = 0.5, sweeps: int = 100, held: float = 0.2, base_seed: int = 0, bags: tuple[list[Model], list[Member]] | None = None
) -> Model:
    """Adds a ridge correction on the cells of the model's own single features and pairs.

    With ``bags`` (their models and members) a row's residual -g/h, with weight h, is taken at its out-of-bag score, so no
    tree behind it saw the row, and rows that every bag drew take no part; without, at the model's own score. All cells
    are solved for jointly (``ridge.RidgeSystem``), so no support is ever dropped. A flat first solve tells how strong
    each support is, and weaker ones are shrunk more. How much of it is kept, from nothing to all, is decided on rows held
    out of the solve: the deviance there never rises. With bags those rows are new to the scores they correct, too;
    where no row is held out all of it is kept.
    """
    loss = loss_by_name(model.objective, model.tweedie_rho)
    layout = _layout(model, supports_of(model))
    width = sum(size for *_, size in layout)
    if not width:
        return model
    names = [f"b{i}" for i in range(len(model.axes))]
    limit = np.uint64(int(held * 2**64))
    ddl = ", ".join(f"{n} smallint" for n in names) + ", y double, w double, raw double, held boolean, g double, h double"
    schema = arrow_schema(ddl)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {n: x.to_numpy(zero_copy_only=False) for n, x in zip(batch.schema.names, batch.columns, strict=True)}
            bins = [data[n] for n in names]
            if bags is None:
                raw, used = model.raw_score(bins), np.ones(batch.num_rows, bool)
            else:
                raw, count = out_of_bag(*bags, data, bins)
                used = count > 0
            raw = (raw + data["off"])[used]
            out = seed.mix_seed_array(base_seed, 0, seed.STAGES["holdout"], data["rid"])[used] < limit
            y, w = data["y"][used], data["w"][used]
            g, h = loss.numpy_gradient(y, raw, w)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*[b[used].astype(np.int16) for b in bins], y, w, raw, out, g, h)], schema=schema)

    rows = staged(binned.select("rid", *names, "y", "w", "off").mapInArrow(score, ddl), "residuals")

    def cells(data: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        return [_column(maps, [data[f"b{a}"] for a in u]) for u, maps, *_ in layout], data["g"], data["h"]

    system = ridge.RidgeSystem(rows.where("not held"), [size for *_, size in layout], cells, np.ones(len(layout)))
    sizes = np.array([size for *_, size in layout])
    flat = system.solve(np.full(width, base), steps=min(sweeps, 30), tolerance=1e-4)
    strength = np.array([np.sqrt(np.mean(flat[f : f + s] ** 2)) for _, _, f, s in layout]) ** gamma
    weight = np.maximum(strength / max(strength.mean(), 1e-300), 1e-3)
    delta = system.solve(np.repeat(base / weight**2, sizes), start=flat, steps=sweeps, tolerance=1e-6)

    shrink_schema = arrow_schema("i int, d double, n long")

    def deviances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(SHRINKS)), 0
        for batch in batches:
            data = {c: x.to_numpy(zero_copy_only=False) for c, x in zip(batch.schema.names, batch.columns, strict=True)}
            shift = sum(delta[first + _column(maps, [data[f"b{a}"] for a in u])] for u, maps, first, _ in layout)
            n += batch.num_rows
            for k, s in enumerate(SHRINKS):
                found[k] += loss.numpy_deviance(data["y"], data["raw"] + s * shift, data["w"]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SHRINKS), dtype=np.int32)), pa.array(found), pa.array([n] * len(SHRINKS), pa.int64())], schema=shrink_schema)

    by_shrink = rows.where("held").mapInArrow(deviances, "i int, d double, n long").groupBy("i").agg(F.sum(F.col("d").cast(DECIMAL)).cast("double").alias("d"), F.sum("n").alias("n")).orderBy("i").collect()
    share = SHRINKS[int(np.argmin([r["d"] for r in by_shrink]))] if by_shrink and by_shrink[0]["n"] else 1.0
    if not share:
        return model
    corrections = list(model.corrections)
    for u, maps, first, size in layout:
        values = share * delta[first : first + size].reshape([m.max() + 1 for m in maps])
        corrections.append(Correction(u, values[np.ix_(*maps)]))
    out = replace(model, corrections=corrections)
    out.validate()
    return out


@dataclass(frozen=True)
class CellRefit:
    """Correct a bagged model on its out-of-bag residuals: base penalty, and how much more weak supports are shrunk."""

    base: float = 4000.0
    gamma: float = 2.0

    def __post_init__(self) -> None:
        if not (np.isfinite(self.base) and self.base > 0 and np.isfinite(self.gamma) and self.gamma >= 0):
            raise InvalidParameter("a cell refit needs a finite base > 0 and a finite gamma >= 0")


#: Share of the rows that decide how much of an out-of-bag correction is kept.
OUT_OF_BAG_HELD = 38 / 256


@dataclass(frozen=True)
class SettingsGrid:
    """Settings to choose from; a library's members are read off it as digits of their number, first field first."""

    ridges: tuple[float, ...] = (0.0, 1.0, 10.0)
    learning_rates: tuple[float, ...] = (0.03, 0.05, 0.1)
    n_trees: tuple[int, ...] = (250, 500, 1000)
    max_orders: tuple[int, ...] = (2, 3)
    noises: tuple[float, ...] = (0.0,)

    def __post_init__(self) -> None:
        if not all((self.ridges, self.learning_rates, self.n_trees, self.max_orders, self.noises)):
            raise InvalidParameter("every list of a settings grid has a value")
        if any(x < 0 for x in (*self.ridges, *self.noises)) or any(x <= 0 for x in (*self.learning_rates, *self.n_trees)) or any(not 1 <= x <= 3 for x in self.max_orders):
            raise InvalidParameter("a settings grid holds ridges and noises >= 0, rates and trees > 0, orders from 1 to 3")

    def at(self, number: int, config: BoostConfig) -> BoostConfig:
        """``config`` with the settings of member ``number``."""
        picked = []
        for values in (self.ridges, self.learning_rates, self.n_trees, self.max_orders, self.noises):
            picked.append(values[number % len(values)])
            number //= len(values)
        r, rate, trees, order, noise = picked
        return replace(config, learning_rate=rate, n_trees=trees, max_order=order, split=replace(config.split, ridge=r, noise=noise))


@dataclass(frozen=True)
class Selection:
    """Fit ``library_size`` settings of a grid and average those that greedy selection picks on held-out rows."""

    library_size: int = 8
    grid: SettingsGrid = SettingsGrid()
    picks: int = 10
    bags: int = 4

    def __post_init__(self) -> None:
        if self.library_size < 1 or self.picks < 1 or self.bags < 1:
            raise InvalidParameter("a selection needs a library, picks and bags of at least one")


def fit_model(booster: Booster, binned: DataFrame, cell_refit: CellRefit | None = None, selection: Selection | None = None) -> Model:
    """Fits whatever ensemble is asked for: one model, bags, bags with an out-of-bag correction, or a selection."""
    config = booster.config
    if cell_refit is not None and config.n_bags < 2:
        raise InvalidParameter("a cell refit needs n_bags >= 2, for residuals that no tree has seen")
    if selection is not None:
        if config.n_bags:
            raise InvalidParameter("choose bags or a selection")
        library = [selection.grid.at(k, config) for k in range(selection.library_size)]
        return select_ensemble(binned, booster.axes, booster.objective, library, selection.picks, base_seed=config.seed, bags=selection.bags, tweedie_rho=booster.rho)
    if cell_refit is None:
        return booster.fit(binned)
    models, members = booster.fit_members(binned)
    averaged = booster.averaged(models)
    return cell_correction(binned, averaged, cell_refit.base, cell_refit.gamma, held=OUT_OF_BAG_HELD, base_seed=config.seed, bags=(models, members))


def select_ensemble(
    binned: DataFrame, axes: list[Axis], objective: str, library: list[BoostConfig], picks: int = 10, held: float = 0.2, base_seed: int = 0, bags: int = 4, tweedie_rho: float = 1.5
) -> Model:
    """Fits each setting on the training part and averages those that greedy selection picks on the held-out part.

    Members grow together, on one histogram job a level. Selection sees at most ``SELECT_ROWS`` held-out rows, those with
    the smallest hashes.
    """
    if not library:
        raise InvalidParameter("the library is empty")
    rows = staged(binned, "library")
    z = seed.row_hash(F.col("rid"), base_seed, 1, seed.STAGES["holdout"])
    marked = rows.withColumn("_z", z)
    cut = int(held * 2**63)
    train = marked.where(F.col("_z") >= cut).drop("_z")
    sample = marked.where(F.col("_z") < cut).orderBy("_z", "rid").limit(SELECT_ROWS).toArrow()
    models, _ = Booster(axes, objective, library[0], tweedie_rho).fit_members(train, library)
    loss = loss_by_name(objective, tweedie_rho)
    bins = [sample.column(f"b{i}").to_numpy() for i in range(len(axes))]
    offset = sample.column("off").to_numpy()
    scores = [m.raw_score(bins) + offset for m in models]
    weights = greedy_average(scores, sample.column("y").to_numpy(), sample.column("w").to_numpy(), loss, picks, bags, base=base_seed)
    trees = [(float(w) * alpha, tree) for w, m in zip(weights, models, strict=True) if w for alpha, tree in m.trees]
    out = replace(models[0], f0=float(sum(w * m.f0 for w, m in zip(weights, models, strict=True))), trees=trees)
    out.validate()
    return out
