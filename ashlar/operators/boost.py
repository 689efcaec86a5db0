"""The boosting loop: one histogram job per tree level for all fits that grow together, the rest on a few numbers.

Rows stay binned in a stored table, with one raw score for each member: a bag, or a setting of a library. A job's tasks
score their rows with the trees so far, take gradients, follow the splits of the trees in work, and sum (member, leaf,
axis, bin) cells in numpy; what comes to the driver is at most 2 leaves x axes x 255 rows a member. Below a tree's root
only the smaller child of each leaf is counted, and its sibling is what the parent has besides. Every ``restage`` trees the
raw scores are written with the rows, so scoring stays short and no lineage grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seed
from ..functions.losses import Loss, loss_by_name
from ..session import arrow_schema, spread, staged
from .histogram import DECIMAL, arrow_histograms
from .model import Axis, InvalidParameter, Model, Split, Tree
from .ridge import RidgeSystem
from .sampling import POISSON_STEPS, dropped_trees, sampled_columns
from .split import SplitConfig, clamp_monotone, find_split, leaf_values


@dataclass(frozen=True)
class BoostConfig:
    n_trees: int = 1000
    learning_rate: float = 0.05
    rate_decay: float = 0.0
    max_order: int = 3
    split: SplitConfig = field(default_factory=SplitConfig)
    subsample: float = 1.0
    min_sampled_rows: int = 1
    colsample: float = 1.0
    validation_fraction: float = 0.0
    early_stopping: int = 0
    leaf_refine_steps: int = 0
    refine_backtracks: int = 6
    dart_rate: float = 0.0
    n_bags: int = 0
    bag_subsample: float = 0.8
    bootstrap: bool = False  # bags of rows drawn with repetition, as Poisson counts, instead of subsamples
    ridge_refit: bool = False
    reanchor: bool | None = None
    restage: int = 40
    hist_bits: int = 30  # gradients in histograms are whole numbers of so many bits; fewer find splits more coarsely
    seed: int = 0

    def __post_init__(self) -> None:
        if self.n_trees < 0 or not 0 < self.learning_rate <= 1 or not 1 <= self.max_order <= 3:
            raise InvalidParameter("n_trees >= 0, 0 < learning_rate <= 1, max_order from 1 to 3")
        for name in ("subsample", "colsample", "bag_subsample"):
            if not 0 < getattr(self, name) <= 1:
                raise InvalidParameter(f"{name} lies in (0, 1]")
        if not 0 <= self.validation_fraction < 1 or not 0 <= self.dart_rate < 1:
            raise InvalidParameter("validation_fraction and dart_rate lie in [0, 1)")
        if not 4 <= self.hist_bits <= 30:
            raise InvalidParameter("hist_bits lies between 4 and 30")
        if self.early_stopping and not self.validation_fraction:
            raise InvalidParameter("early stopping needs a validation fraction")


def _uniform(keys: np.ndarray, base: int, round_: int, stage: str) -> np.ndarray:
    return (seed.mix_seed_array(base, round_, seed.STAGES[stage], keys).astype(np.float64) + 0.5) / 2**64


#: Cells of all members that one histogram job holds in a task; more members take several jobs a level.
HISTOGRAM_CELLS = 1 << 22


@dataclass
class Member:
    """One of the fits that grow together: its setting, its rows as bounds on their hashes, and what it has grown."""

    config: BoostConfig
    column: str
    bound: dict
    f0: float = 0.0
    trees: list[tuple[float, Tree]] = field(default_factory=list)
    done: int = 0  # trees already in the stored raw score
    best: float = np.inf
    best_at: int = 0
    growing: bool = True

    def active(self, round_: int) -> tuple[list[tuple[float, Tree]], list[int]]:
        """The trees that the stored score lacks and this round looks at, and those that dropout leaves out."""
        if not self.config.dart_rate:
            return self.trees[self.done :], []
        drop = dropped_trees(len(self.trees), self.config.dart_rate, self.bound["base"], round_)
        return [x for i, x in enumerate(self.trees) if i not in set(drop)], drop

    def take(self, tree: Tree, drop: list[int]) -> None:
        if not drop:
            self.trees.append((1.0, tree))
            return
        k = len(drop)
        for i in drop:
            self.trees[i] = (self.trees[i][0] * k / (k + 1), self.trees[i][1])
        self.trees.append((1 / (k + 1), tree))


@dataclass
class Growth:
    """A member's tree in work: its round's trees, splits, sample, and the sums its levels left behind."""

    member: Member
    active: list[tuple[float, Tree]]
    drop: list[int]
    columns: list[int]
    sample: tuple | None = None
    splits: tuple[Split, ...] = ()
    history: list[np.ndarray] = field(default_factory=list)
    parents: np.ndarray | None = None  # histogram of the level above
    counted: np.ndarray | None = None  # of each of its leaves, the child with fewer rows
    growing: bool = True


class Booster:
    """Fits a ``Model`` to binned rows: ``rid, b0.., y, w, off``."""

    def __init__(self, axes: list[Axis], objective: str = "squared_error", config: BoostConfig = BoostConfig(), tweedie_rho: float = 1.5) -> None:
        self.axes, self.loss = axes, loss_by_name(objective, tweedie_rho)
        self.objective, self.rho = self.loss.name, tweedie_rho
        self.config = self._bounded(config)
        self.bins = max((a.data_bins for a in axes), default=1) + 1
        self.log: list[dict] = []

    def _bounded(self, config: BoostConfig) -> BoostConfig:
        if self.loss.max_delta_step and not config.split.max_delta:
            return replace(config, split=replace(config.split, max_delta=self.loss.max_delta_step))
        return config

    @property
    def columns(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.axes))]

    def fit(self, binned: DataFrame) -> Model:
        """One model, or with ``n_bags`` the average of independent fits on subsamples."""
        models, _ = self.fit_members(binned)
        return self.averaged(models) if self.config.n_bags else models[0]

    def averaged(self, models: list[Model]) -> Model:
        trees = [(alpha / len(models), tree) for m in models for alpha, tree in m.trees]
        return self._model(float(f"{sum(m.f0 for m in models) / len(models):.12g}"), trees)

    def _model(self, f0: float, trees: list[tuple[float, Tree]]) -> Model:
        out = Model(f0, trees, self.axes, self.objective, self.loss.link, self.rho)
        out.validate()
        return out

    def fit_members(self, binned: DataFrame, library: list[BoostConfig] | None = None) -> tuple[list[Model], list[Member]]:
        """The models of all bags (or of a library's settings, on all rows), grown together."""
        rows = staged(spread(binned.select("rid", *self.columns, "y", "w", "off")), "binned")
        self.loss.checked(rows)
        if library is None:
            bags = [None] if not self.config.n_bags else list(range(self.config.n_bags))
            members = [Member(self.config, f"raw{i}", {"base": self._base(self.config, bag), "held": 0, "bag": None}) for i, bag in enumerate(bags)]
        else:
            bags = [None] * len(library)
            members = [Member(self._bounded(c), f"raw{i}", {"base": c.seed, "held": 0, "bag": None}) for i, c in enumerate(library)]
        self._set_bounds(rows, members, bags)
        self._set_starts(rows, members)
        self._grow_all(rows.select("*", *[(F.lit(m.f0) + F.col("off")).alias(m.column) for m in members]), members)
        return [self._finished(rows, m) for m in members], members

    @staticmethod
    def _base(config: BoostConfig, bag: int | None) -> int:
        return config.seed if bag is None else seed.mix_seed(config.seed, bag, seed.STAGES["bags"], 0)

    def _set_bounds(self, binned: DataFrame, members: list[Member], bags: list[int | None]) -> None:
        """Which rows train and which are held out, as bounds on their hashes: no list of rows is kept."""
        wanted = []
        for m, bag in zip(members, bags, strict=True):
            for name, fraction, stage in (("held", m.config.validation_fraction, "holdout"), ("bag", m.config.bag_subsample if bag is not None else 0.0, "bags")):
                if name == "bag" and fraction and m.config.bootstrap:
                    m.bound["drawn"] = True
                elif fraction:
                    wanted.append((m, name, fraction, stage))
        if not wanted:
            return
        n = binned.count()
        ranks = [min(max(int(np.ceil(fraction * n)), 1), n - 1 if name == "held" else n) for _, name, fraction, _ in wanted]
        for (m, name, *_), bound in zip(wanted, kth_hashes(binned, [(m.bound["base"], stage, k) for (m, _, _, stage), k in zip(wanted, ranks, strict=True)]), strict=True):
            m.bound[name] = bound

    def _set_starts(self, binned: DataFrame, members: list[Member]) -> None:
        """Each member's start score: that of its bag's rows, or of all rows. One job, a row per member and task."""
        names = ["w", "wy", "wd", "we"]
        ddl = "i int, " + ", ".join(f"{c} double" for c in names)
        schema, bounds = arrow_schema(ddl), [m.bound for m in members]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, len(bounds)))
            for batch in batches:
                rid, y, w, off = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                terms = (w, w * y, w * (y - off), w * np.exp(off))
                for i, bound in enumerate(bounds):
                    times = drawn(rid, bound)
                    total[:, i] += [(t * times).sum() for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bounds), dtype=np.int32)), *[pa.array(t) for t in total]], schema=schema)

        sums = binned.select("rid", "y", "w", "off").mapInArrow(run, ddl).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
        for r in sums.collect():
            # the sums' last digits depend on their order
            members[r["i"]].f0 = float(f"{self.loss.start_from(*[r[c] for c in names]):.12g}")

    def _grow_all(self, state: DataFrame, members: list[Member]) -> None:
        unit = self._unit(state, members)
        for t in range(max((m.config.n_trees for m in members), default=0)):
            for m in members:
                m.growing = m.growing and t < m.config.n_trees
            living = [m for m in members if m.growing]
            if not living:
                break
            grown = self._grow(state, living, t, unit)
            for growth, tree in grown:
                if tree is None:
                    growth.member.growing = False
                else:
                    growth.member.take(tree, growth.drop)
            watched = [g.member for g, tree in grown if tree is not None and g.member.config.early_stopping]
            if watched:
                values = self._deviances(state, [(m, m.active(-1)[0] if not m.config.dart_rate else m.trees, [None]) for m in watched], held=True)
                for m, value in zip(watched, values, strict=True):
                    self.log.append({"trees": len(m.trees), "deviance": float(value[0])})
                    if value[0] < m.best:
                        m.best, m.best_at = float(value[0]), len(m.trees)
                    elif len(m.trees) - m.best_at >= m.config.early_stopping:
                        m.growing = False
            if any(not m.config.dart_rate and len(m.trees) - m.done >= m.config.restage for m in members if m.growing):
                state = self._restage(state, members)
        for m in members:
            if m.config.early_stopping and m.best_at:
                m.trees = m.trees[: m.best_at]

    def _finished(self, binned: DataFrame, member: Member) -> Model:
        c, f0, trees = member.config, member.f0, member.trees
        if c.ridge_refit and trees:
            trees = self._ridge(binned, member, trees)
        if c.reanchor or (c.reanchor is None and self.loss.link == "log"):
            f0 += self.anchor(binned, member, trees)
        return self._model(float(f"{f0:.12g}"), trees)

    def _unit(self, state: DataFrame, members: list[Member]) -> float:
        found = []
        for m in members:
            g, h = self.loss.gradient(F.col("y"), F.col(m.column), F.col("w"))
            found += [F.max(F.abs(g)), F.max(F.abs(h))]
        top = max([x for x in state.agg(*found).first() if x] or [1])
        return float(2.0 ** np.ceil(np.log2(max(top, 1e-300))))

    def _rows(self, growth: Growth):
        """A function from a batch's columns to (bins, leaf, g, h, w); leaf -1 leaves a row out."""
        columns, loss, member = self.columns, self.loss, growth.member
        column, bound, active, splits, sample = member.column, member.bound, growth.active, growth.splits, growth.sample

        def state(batch: dict[str, np.ndarray]):
            if bound.get("drawn"):
                again = np.repeat(np.arange(len(batch["rid"])), drawn(batch["rid"], bound))
                batch = {c: batch[c][again] for c in ("rid", "y", "w", column, *columns)}
            bins = [batch[c] for c in columns]
            raw = batch[column].copy()
            for alpha, tree in active:
                raw += alpha * tree.score(bins)
            g, h = loss.numpy_gradient(batch["y"], raw, batch["w"])
            leaf = np.zeros(len(raw), np.int64)
            for level, s in enumerate(splits):
                leaf |= s.low(bins[s.axis]).astype(np.int64) << level
            leaf[~_trains(batch["rid"], bound)] = -1
            if sample is not None:
                round_, threshold = sample
                u = _uniform(batch["rid"], bound["base"], round_, "rows")
                leaf[np.log(u) / np.sqrt(g * g + h * h) < threshold] = -1
            return bins, leaf, g, h, batch["w"]

        return state

    def _needed(self, state: DataFrame, members: list[Member]) -> DataFrame:
        return state.select("rid", *self.columns, "y", "w", *[m.column for m in members])

    def _set_samples(self, state: DataFrame, growths: list[Growth], t: int) -> None:
        """The key that the k-th largest row of this round has, by an approximate quantile of the keys; one job."""
        sampled = [g for g in growths if g.member.config.subsample < 1]
        if not sampled:
            return
        parts, schema = [self._rows(g) for g in sampled], arrow_schema("i int, k double")
        bases = [g.member.bound["base"] for g in sampled]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = {n: x.to_numpy(zero_copy_only=False) for n, x in zip(batch.schema.names, batch.columns, strict=True)}
                for i, (rows, base) in enumerate(zip(parts, bases, strict=True)):
                    _, leaf, g, h, _ = rows(data)
                    key = (np.log(_uniform(data["rid"], base, t, "rows")) / np.sqrt(g * g + h * h))[leaf >= 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key)], schema=schema)

        keys = self._needed(state, [g.member for g in sampled]).mapInArrow(run, "i int, k double")
        rates = F.array(*[F.lit(1 - g.member.config.subsample) for g in sampled])
        for r in keys.groupBy("i").agg(F.percentile_approx("k", rates, F.lit(100_000)).alias("q"), F.count("*").alias("n")).collect():
            own = sampled[r["i"]]
            own.sample = (t, float("-inf") if r["n"] <= own.member.config.min_sampled_rows else float(r["q"][r["i"]]))

    def _histograms(self, state: DataFrame, growths: list[Growth], unit: float) -> list[np.ndarray]:
        """``[leaf, axis, bin, (g, h, w, n)]`` of each tree in work, at its present level.

        At a root all rows are counted. Below it, of each leaf's two children the one with fewer rows; the other one is
        its parent less that.
        """
        width = len(self.axes)

        def part(growth: Growth):
            rows, counted, columns = self._rows(growth), growth.counted, growth.columns

            def state_of(batch: dict[str, np.ndarray]):
                bins, leaf, g, h, w = rows(batch)
                if counted is not None:
                    parent = leaf & (len(counted) - 1)
                    leaf = np.where((leaf >= 0) & (leaf == counted[parent]), parent, -1)
                return {a: bins[a] for a in columns}, leaf, g, h, w

            return state_of

        out = []
        sizes = [1 if g.counted is None else len(g.counted) for g in growths]
        many = max(1, HISTOGRAM_CELLS // max(1, max(sizes) * width * self.bins))
        for lo in range(0, len(growths), many):
            some = growths[lo : lo + many]
            rows = self._needed(state, [g.member for g in some])
            found = arrow_histograms(rows, width, sizes[lo : lo + many], self.bins, [part(g) for g in some], unit)
            for growth, small in zip(some, found, strict=True):
                if growth.counted is None:
                    out.append(small)
                    continue
                rest = growth.parents - small
                rest[rest[..., 3] == 0] = 0
                full = np.zeros((2 * len(small), *small.shape[1:]))
                other = growth.counted ^ len(small)
                full[growth.counted], full[other] = small, rest
                out.append(full)
        return out

    def _grow(self, state: DataFrame, members: list[Member], t: int, unit: float) -> list[tuple[Growth, Tree | None]]:
        """One tree for each member, level by level on shared jobs; None where no split is admitted."""
        growths = []
        for m in members:
            active, drop = m.active(t)
            growths.append(Growth(m, active, drop, sampled_columns(len(self.axes), m.config.colsample, m.bound["base"], t)))
        self._set_samples(state, growths, t)
        for level in range(max(m.config.max_order for m in members)):
            open_ = [g for g in growths if g.growing and level < g.member.config.max_order]
            if not open_:
                break
            coarse = unit * 2.0 ** (30 - max(m.config.hist_bits for m in members))
            for growth, hist in zip(open_, self._histograms(state, open_, coarse), strict=True):
                if not level:
                    growth.history.append(hist[:, growth.columns[0]].sum(1))
                c = growth.member.config
                found = find_split(hist, self.axes, list(growth.splits), c.split, growth.columns, growth.member.bound["base"], t)
                if found is None:
                    growth.growing = False
                    continue
                split, _, sums = found
                growth.splits += (split,)
                growth.history.append(sums.transpose(1, 0, 2).reshape(-1, 4))
                leaves = np.arange(len(sums))
                growth.parents, growth.counted = hist, np.where(sums[:, 1, 3] < sums[:, 0, 3], leaves | len(sums), leaves)
        made = [g for g in growths if g.splits]
        # the leaves' values are told from all rows and whole gradients, whatever found the splits
        sampled = [g for g in made if g.sample is not None or g.member.config.hist_bits < 30]
        whole = dict(zip(map(id, sampled), self._leaf_sums(state, [replace(g, sample=None) for g in sampled], unit), strict=True)) if sampled else {}
        trees: dict[int, Tree] = {}
        for g in made:
            c = g.member.config
            sums, history = (whole[id(g)], None) if id(g) in whole else (g.history[-1], g.history)
            rate = c.learning_rate / (1 + c.rate_decay * t)
            tree = Tree(g.splits, tuple(leaf_values(sums, c.split, list(g.splits), rate, history).tolist()))
            if c.leaf_refine_steps and self.loss.name == "squared_error":
                tree = self._refine_squares(tree, sums, c)
            trees[id(g)] = tree
        slow = [g for g in made if g.member.config.leaf_refine_steps and self.loss.name != "squared_error"]
        if slow:
            trees.update(zip(map(id, slow), self._refine(state, slow, [trees[id(g)] for g in slow], unit), strict=True))
        return [(g, trees.get(id(g))) for g in growths]

    def _leaf_sums(self, state: DataFrame, growths: list[Growth], unit: float) -> list[np.ndarray]:
        """Sums of all training rows by leaf, ``[leaf, (g, h, w, n)]``, for each tree; one job."""

        def part(growth: Growth):
            rows = self._rows(growth)

            def flat(batch):
                _, leaf, g, h, w = rows(batch)
                return {0: np.zeros(len(leaf), np.int64)}, leaf, g, h, w

            return flat

        found = arrow_histograms(self._needed(state, [g.member for g in growths]), 1, [1 << len(g.splits) for g in growths], 1, [part(g) for g in growths], unit)
        return [x[:, 0, 0] for x in found]

    @staticmethod
    def _trials(tree: Tree, delta: np.ndarray, c: BoostConfig) -> list[Tree]:
        scales = [0.0, *[0.5**k for k in range(c.refine_backtracks + 1)]]
        return [Tree(tree.splits, tuple(clamp_monotone(np.array(tree.leaves) + s * delta, list(tree.splits), c.split.monotone).tolist())) for s in scales]

    def _refine_squares(self, tree: Tree, sums: np.ndarray, c: BoostConfig) -> Tree:
        """Newton steps on the leaves for squared errors without another look at the rows.

        A leaf's share of the deviance is a constant plus ``v * g + v * v * w / 2`` for its value ``v``, with the sums of
        gradients and weights at value zero, so steps and their backtracking follow from the sums that growing left.
        """
        g, h, w = sums[:, 0], sums[:, 1], sums[:, 2]

        def loss(trial: Tree) -> float:
            v = np.array(trial.leaves)
            return float((v * g + v * v * w / 2).sum())

        for _ in range(c.leaf_refine_steps):
            now = np.stack([g + w * np.array(tree.leaves), h, w, sums[:, 3]], 1)
            delta = leaf_values(now, replace(c.split, path_smooth=0.0), list(tree.splits), c.learning_rate)
            if (np.abs(delta) <= 1e-7).all():
                break
            trials = self._trials(tree, delta, c)
            before = loss(trials[0])
            better = next((x for x in trials[1:] if loss(x) < before), None)
            if better is None:
                break
            tree = better
        return tree

    def _refine(self, state: DataFrame, growths: list[Growth], trees: list[Tree], unit: float) -> list[Tree]:
        """Newton steps on the leaves, each halved until the deviance falls: two jobs a step for all trees and scales."""
        trees, open_ = list(trees), list(range(len(trees)))
        for step in range(max(g.member.config.leaf_refine_steps for g in growths)):
            open_ = [k for k in open_ if step < growths[k].member.config.leaf_refine_steps]
            if not open_:
                break
            now = [replace(growths[k], active=[*growths[k].active, (1.0, trees[k])], splits=trees[k].splits, sample=None) for k in open_]
            asked = []
            for k, sums in zip(open_, self._leaf_sums(state, now, unit), strict=True):
                c = growths[k].member.config
                delta = leaf_values(sums, replace(c.split, path_smooth=0.0), list(trees[k].splits), c.learning_rate)
                if (np.abs(delta) > 1e-7).any():
                    asked.append((k, self._trials(trees[k], delta, c)))
            open_ = []
            values = self._deviances(state, [(growths[k].member, growths[k].active, trials) for k, trials in asked]) if asked else []
            for (k, trials), found in zip(asked, values, strict=True):
                better = [i for i in range(1, len(trials)) if found[i] < found[0]]
                if better:
                    trees[k] = trials[better[0]]
                    open_.append(k)
        return trees

    def _deviances(self, state: DataFrame, asked: list[tuple[Member, list[tuple[float, Tree]], list[Tree | None]]], held: bool = False) -> list[np.ndarray]:
        """Deviance of the training (or held-out) rows under each trial tree of each member, in one job."""
        columns, loss = self.columns, self.loss
        parts = [(m.column, m.bound, active, trials) for m, active, trials in asked]
        starts = np.concatenate(([0], np.cumsum([len(trials) for *_, trials in parts])))
        ddl = "i int, d double"
        schema = arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(starts[-1])
            for batch in batches:
                data = {n: x.to_numpy(zero_copy_only=False) for n, x in zip(batch.schema.names, batch.columns, strict=True)}
                bins = [data[c] for c in columns]
                for first, (column, bound, active, trials) in zip(starts, parts, strict=False):
                    raw = data[column].copy()
                    for alpha, tree in active:
                        raw += alpha * tree.score(bins)
                    used = _held(data["rid"], bound) & in_bag(data["rid"], bound) if held else _trains(data["rid"], bound)
                    w = data["w"] * drawn(data["rid"], bound)
                    for i, trial in enumerate(trials):
                        f = raw if trial is None else raw + trial.score(bins)
                        total[first + i] += loss.numpy_deviance(data["y"][used], f[used], w[used]).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

        rows = self._needed(state, list({m.column: m for m, *_ in asked}.values()))
        sums = rows.mapInArrow(run, ddl).groupBy("i").agg(F.sum(F.col("d").cast(DECIMAL)).cast("double").alias("d"))
        flat = np.array([r["d"] for r in sums.orderBy("i").collect()])
        return [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def _restage(self, state: DataFrame, members: list[Member]) -> DataFrame:
        """Writes the rows with the scores of all trees so far; dropout changes trees, so its scores stay as they are."""
        columns = self.columns
        moved = [(state.columns.index(m.column), m.trees[m.done :]) for m in members if not m.config.dart_rate]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
                arrays = list(batch.columns)
                for at, trees in moved:
                    raw = arrays[at].to_numpy(zero_copy_only=False).copy()
                    for alpha, tree in trees:
                        raw += alpha * tree.score(bins)
                    arrays[at] = pa.array(raw)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

        out = staged(state.mapInArrow(run, state.schema), "scored")
        for m in members:
            if not m.config.dart_rate:
                m.done = len(m.trees)
        return out

    def _scored(self, binned: DataFrame, member: Member, trees: list[tuple[float, Tree]]) -> DataFrame:
        """``y, w, raw`` of the member's rows under ``trees``."""
        columns, bound = self.columns, member.bound
        schema = arrow_schema("y double, w double, raw double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = {n: x.to_numpy(zero_copy_only=False) for n, x in zip(batch.schema.names, batch.columns, strict=True)}
                own = in_bag(data["rid"], bound)
                bins, raw = [data[c][own] for c in columns], data["raw"][own]
                for alpha, tree in trees:
                    raw = raw + alpha * tree.score(bins)
                w = (data["w"] * drawn(data["rid"], bound))[own]
                yield pa.RecordBatch.from_arrays([pa.array(data["y"][own]), pa.array(w), pa.array(raw)], schema=schema)

        rows = binned.select("rid", *columns, "y", "w", (F.lit(member.f0) + F.col("off")).alias("raw"))
        return rows.mapInArrow(run, "y double, w double, raw double")

    def anchor(self, binned: DataFrame, member: Member, trees) -> float:
        """Shift of the intercept after which predictions and targets have the same weighted total, over all its rows."""
        scored = self._scored(binned, member, trees)
        y, w, raw = F.col("y"), F.col("w"), F.col("raw")
        if self.loss.link == "identity":
            row = scored.agg(F.sum(w * (y - raw)), F.sum(w)).first()
            return row[0] / row[1]
        if self.loss.link == "log":
            row = scored.agg(F.sum(w * y), F.sum(w * F.exp(raw))).first()
            return float(np.log(max(row[0] / row[1], 1e-12)))
        scored, shift = staged(scored, "anchor"), 0.0
        for _ in range(25):
            p = self.loss.inverse_link(raw + F.lit(shift))
            row = scored.agg(F.sum(w * (y - p)), F.sum(w * p * (1 - p))).first()
            change = row[0] / max(row[1], 1e-12)
            shift += float(np.clip(change, -2, 2))
            if abs(change) < 1e-10:
                break
        return shift

    def _ridge(self, binned: DataFrame, member: Member, trees: list[tuple[float, Tree]], backtracks: int = 8) -> list[tuple[float, Tree]]:
        """Refits all leaves of all trees at once, with a penalty on their values; halved until the deviance falls.

        A row stands in one leaf of each tree. The system of all leaves is solved on the sums that two leaves share where
        they are few, and otherwise by a conjugate gradient, a job a step: one number per leaf leaves a task, however
        many trees there are. All trial steps are judged in one job. Pass stored rows.
        """
        columns, loss, bound = self.columns, self.loss, member.bound
        rows = binned.select("rid", *columns, "y", "w", (F.lit(member.f0) + F.col("off")).alias(member.column))

        def cells(data: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            own = in_bag(data["rid"], bound)
            bins, raw, at = [data[c][own] for c in columns], data[member_column][own].copy(), []
            for alpha, tree in trees:
                leaf = tree.leaf(bins)
                raw += alpha * np.array(tree.leaves)[leaf]
                at.append(leaf)
            g, h = loss.numpy_gradient(data["y"][own], raw, (data["w"] * drawn(data["rid"], bound))[own])
            return at, g, h

        member_column = member.column
        system = RidgeSystem(rows, [len(t.leaves) for _, t in trees], cells, np.array([alpha for alpha, _ in trees]))
        starts, leaves = system.starts, np.concatenate([t.leaves for _, t in trees])
        penalty = np.full(len(leaves), max(member.config.split.ridge, 1e-6))
        delta = system.solve(penalty, pull=-penalty * leaves)

        def moved(share: float) -> list[tuple[float, Tree]]:
            values = leaves + share * delta
            out = []
            for i, (alpha, tree) in enumerate(trees):
                own = clamp_monotone(values[starts[i] : starts[i + 1]], list(tree.splits), member.config.split.monotone)
                out.append((alpha, Tree(tree.splits, tuple(own.tolist()))))
            return out

        everyone = Member(member.config, member.column, {**bound, "held": 0})
        tried = [trees, *[moved(0.5**k) for k in range(backtracks)]]
        values = self._deviances(rows, [(everyone, some, [None]) for some in tried])
        return next((some for some, value in zip(tried[1:], values[1:], strict=True) if value[0] < values[0][0]), trees)


def kth_hashes(rows: DataFrame, wanted: list[tuple[int, str, int]]) -> list[int]:
    """For each ``(base, stage, k)`` a bound that exactly the ``k`` smallest 63-bit hashes of ``rid`` do not exceed.

    Hashes are counted by their leading bits, twelve more in each job, for all asked at once, until a bin ends where the
    k-th lies; at most 4096 counts for each come to the driver.
    """
    ddl = "i int, b int, n long"
    schema = arrow_schema(ddl)
    out, open_ = [0] * len(wanted), {i: (0, k) for i, (*_, k) in enumerate(wanted)}  # leading bits, rank among them
    width = 63
    while open_:
        step = min(12, width)
        width -= step
        asked, shift = [(i, wanted[i][0], seed.STAGES[wanted[i][1]], prefix) for i, (prefix, _) in open_.items()], width

        def run(batches: Iterator[pa.RecordBatch], asked=asked, shift=shift, step=step) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(asked), 1 << step), np.int64)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for row, (_, base, stage, prefix) in enumerate(asked):
                    z = (seed.mix_seed_array(base, 0, stage, keys) >> np.uint64(1)) >> np.uint64(shift)
                    inside = z[(z >> np.uint64(step)) == np.uint64(prefix)]
                    counts[row] += np.bincount((inside & np.uint64((1 << step) - 1)).astype(np.int64), minlength=1 << step)
            row, b = np.nonzero(counts)
            names = np.array([i for i, *_ in asked], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(b.astype(np.int32)), pa.array(counts[row, b])], schema=schema)

        found: dict[int, dict[int, int]] = {}
        for r in rows.select("rid").mapInArrow(run, ddl).groupBy("i", "b").agg(F.sum("n").alias("n")).collect():
            found.setdefault(r["i"], {})[r["b"]] = r["n"]
        for i, (prefix, k) in list(open_.items()):
            before = 0
            for b in sorted(found.get(i, {})):
                if before + found[i][b] >= k:
                    break
                before += found[i][b]
            lead = prefix << step | b
            out[i] = (lead + 1 << width) - 1
            if before + found[i][b] == k or not width:
                del open_[i]
            else:
                open_[i] = (lead, k - before)
    return out


def drawn(keys: np.ndarray, bound: dict) -> np.ndarray:
    """How often a member's bag has drawn each row: once without a bag, a Poisson count of its hash in a bootstrap."""
    if bound["bag"] is None and not bound.get("drawn"):
        return np.ones(len(keys), np.int64)
    z = seed.mix_seed_array(bound["base"], 0, seed.STAGES["bags"], keys) >> np.uint64(1)
    if bound.get("drawn"):
        return np.searchsorted(POISSON_STEPS, z.astype(np.float64) / 2**63, side="right")
    return (z <= np.uint64(bound["bag"])).astype(np.int64)


def in_bag(keys: np.ndarray, bound: dict) -> np.ndarray:
    """Whether a member's bag has drawn each row; all rows without a bag."""
    return drawn(keys, bound) > 0


def _held(keys: np.ndarray, bound: dict) -> np.ndarray:
    if not bound["held"]:
        return np.zeros(len(keys), bool)
    return (seed.mix_seed_array(bound["base"], 0, seed.STAGES["holdout"], keys) >> np.uint64(1)) <= np.uint64(bound["held"])


def _trains(keys: np.ndarray, bound: dict) -> np.ndarray:
    return in_bag(keys, bound) & ~_held(keys, bound)


def greedy_average(library: list[np.ndarray], y: np.ndarray, w: np.ndarray, loss: Loss, picks: int, bags: int = 4, base: int = 0) -> np.ndarray:
    """Weights of library members by greedy forward selection with repetition, averaged over bootstrap replicates.

    ``library`` holds the members' raw scores on a bounded hold-out sample.
    """
    counts = np.zeros(len(library))
    for bag in range(bags):
        rng = np.random.default_rng(seed.mix_seed(base, bag, seed.STAGES["bags"], 1))
        times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) * w
        total, taken = np.zeros(len(y)), 0
        for _ in range(picks):
            scores = [loss.numpy_deviance(y, (total + m) / (taken + 1), times).sum() for m in library]
            best = int(np.argmin(scores))
            counts[best] += 1
            total, taken = total + library[best], taken + 1
    return counts / counts.sum()
