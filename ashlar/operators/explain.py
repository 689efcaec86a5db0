"""Exact decomposition of a model into a constant and tables of one to three features, and its gates.

A model is small whatever the data: tables are accumulated and purified as arrays on the driver, within cell budgets.
What depends on data, the weight of each cell and the check of the raw tables on rows, is one aggregate each. A triple
over its budget stays factored, tree by tree; ``overflow="sparse"`` also writes its cells as rows (see ``stored_rows``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_schema, staged
from .model import BudgetExceeded, InvalidParameter, InvariantError, Model, NotExact

# Cell budgets per table and per bank, joint cells that are checked exhaustively.
TABLE_CELLS, BANK_CELLS, JOINT_CELLS = 2_000_000, 32_000_000, 1 << 20


@dataclass
class MergedAxis:
    """The cells of a raw feature: 0 is missing, then the intervals between the borders the trees use."""

    raw: int
    axis: int
    cuts: list[int]  # bin_le of the splits, ascending
    borders: list[float]
    name: str

    @property
    def cells(self) -> int:
        return len(self.cuts) + 2

    def cell_of_bin(self, bins: np.ndarray) -> np.ndarray:
        """Cell of each model bin; 0 stays 0."""
        return np.where(bins == 0, 0, 1 + np.searchsorted(self.cuts, bins, side="left"))

    def bin_of_cell(self) -> np.ndarray:
        """A bin that stands for each cell."""
        return np.array([0, *self.cuts, (self.cuts[-1] if self.cuts else 0) + 1])


def merged_axes(model: Model) -> dict[int, MergedAxis]:
    """Per raw feature, the distinct borders that trees split on and, for corrections, all of them."""
    cuts: dict[int, set[int]] = {}
    for _, tree in model.trees:
        for s in tree.splits:
            cuts.setdefault(s.axis, set()).add(s.bin_le)
    for c in model.corrections:
        for a in c.axes:
            cuts.setdefault(a, set()).update(range(1, model.axes[a].data_bins))
    out = {}
    for a, used in cuts.items():
        axis, own = model.axes[a], sorted(used)
        out[axis.raw] = MergedAxis(axis.raw, a, own, [float(axis.borders[t - 1]) for t in own], axis.name)
    return dict(sorted(out.items()))


@dataclass
class Box:
    """One tree of an over-budget triple: eight octants, index bit d set on the low side of its d-th feature."""

    low: tuple[np.ndarray, ...]  # per feature, which cells are low
    octants: np.ndarray  # [2, 2, 2], last feature fastest, 1 = low

    def values(self, cells: tuple[np.ndarray, ...]) -> np.ndarray:
        return self.octants[tuple(m[c].astype(int) for m, c in zip(self.low, cells, strict=True))]


@dataclass
class TableBank:
    f0: float
    tables: dict[tuple[int, ...], np.ndarray]
    axes: dict[int, MergedAxis]
    weights: dict[int, np.ndarray]
    boxes: dict[tuple[int, ...], list[Box]] = field(default_factory=dict)
    link: str = "identity"
    exact: bool = True
    stored: dict[tuple[int, ...], DataFrame] = field(default_factory=dict)  # boxes as rows, where asked for

    def supports(self) -> list[tuple[int, ...]]:
        return sorted({*self.tables, *self.boxes}, key=lambda u: (len(u), u))

    def effect(self, u: tuple[int, ...], cells: dict[int, np.ndarray]) -> np.ndarray:
        at = tuple(cells[r] for r in u)
        out = self.tables[u][at] if u in self.tables else np.zeros(len(at[0]))
        for box in self.boxes.get(u, ()):
            out = out + box.values(at)
        return out

    def score(self, cells: dict[int, np.ndarray]) -> np.ndarray:
        n = len(next(iter(cells.values()))) if cells else 1
        return self.f0 + sum((self.effect(u, cells) for u in self.supports()), np.zeros(n))

    def shap(self, cells: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Each feature's share: every table is split evenly among its features."""
        out = {r: np.zeros(len(next(iter(cells.values())))) for r in self.axes}
        for u in self.supports():
            value = self.effect(u, cells) / len(u)
            for r in u:
                out[r] += value
        return out

    def faith_shap(self, u: tuple[int, ...], cells: dict[int, np.ndarray]) -> np.ndarray:
        """The interaction of exactly these features; 0 if there is no such table."""
        u = tuple(sorted(u))
        return self.effect(u, cells) if u in self.supports() else np.zeros(len(next(iter(cells.values()))))

    def variance(self, u: tuple[int, ...]) -> float:
        w = _outer([self.weights[r] for r in u])
        out = 0.0
        if u in self.tables:
            v = self.tables[u]
            out = float((w * v * v).sum() - (w * v).sum() ** 2)
        boxes = self.boxes.get(u, ())
        if boxes:
            # boxes are centred, so a product of two is a sum over their sides
            for i, a in enumerate(boxes):
                for b in boxes[i:]:
                    mass = [np.array([[self.weights[r][(x.astype(int) == s) & (y.astype(int) == t)].sum() for t in (0, 1)] for s in (0, 1)]) for r, x, y in zip(u, a.low, b.low, strict=True)]
                    inner = np.einsum("abc,ad,be,cf,def->", a.octants, *mass, b.octants)
                    out += float(inner) * (1 if a is b else 2)
        return out

    def sobol(self) -> list[tuple[tuple[int, ...], float]]:
        """Variance shares, largest first; ties by features; all 0 where nothing varies."""
        found = {u: self.variance(u) for u in self.supports()}
        total = sum(found.values())
        return sorted(((u, v / total if total > 0 else 0.0) for u, v in found.items()), key=lambda x: (-x[1], x[0]))

    def recompute_under(self, weights: dict[int, np.ndarray]) -> TableBank:
        """The decomposition of the same function under other weights."""
        if self.boxes:
            raise NotExact("a bank with factored tables cannot be reweighted")
        f0, tables = purify(self.f0, {u: v.copy() for u, v in self.tables.items()}, weights)
        return TableBank(f0, tables, self.axes, weights, {}, self.link, self.exact)


def _outer(parts: list[np.ndarray]) -> np.ndarray:
    out = np.ones(())
    for p in parts:
        out = np.multiply.outer(out, p)
    return out


#: What becomes of a triple over its cell budget: an error, boxes tree by tree, or boxes that are also written as rows.
OVERFLOW = {"error": "error", "hard": "error", "factored": "factored", "factor": "factored", "sparse": "sparse", "sparse_fallback": "sparse"}


def accumulate(model: Model, axes: dict[int, MergedAxis], overflow: str = "factored", table_cells: int | None = None) -> tuple[dict[tuple[int, ...], np.ndarray], dict[tuple[int, ...], list[Box]]]:
    """Tables of alpha * leaf per set of features; sets over the cell budget stay as boxes, or raise."""
    table_cells = TABLE_CELLS if table_cells is None else table_cells
    if overflow not in OVERFLOW:
        raise InvalidParameter(f"overflow is one of {', '.join(OVERFLOW)}, not {overflow!r}")
    tables: dict[tuple[int, ...], np.ndarray] = {}
    boxes: dict[tuple[int, ...], list[Box]] = {}
    spent = 0
    for alpha, tree in model.trees:
        raws = [model.axes[s.axis].raw for s in tree.splits]
        order = np.argsort(raws)
        u = tuple(sorted(raws))
        low = []
        for k in order:
            s, m = tree.splits[k], axes[raws[k]]
            low.append(s.low(m.bin_of_cell()))
        shape = tuple(axes[r].cells for r in u)
        if u not in tables and u not in boxes:
            cells = math.prod(shape)
            if cells > table_cells or spent + cells > BANK_CELLS:
                if OVERFLOW[overflow] == "error" or len(u) < 3:
                    raise BudgetExceeded(f"table {u} has {cells} cells")
                boxes[u] = []
            else:
                tables[u] = np.zeros(shape)
                spent += cells
        if u in boxes:
            octants = np.zeros((2, 2, 2))
            for sides in itertools.product((0, 1), repeat=3):
                octants[sides] = alpha * tree.leaves[sum(side << int(order[d]) for d, side in enumerate(sides))]
            boxes[u].append(Box(tuple(low), octants))
            continue
        leaf = np.zeros(shape, np.int64)
        for d, (k, side) in enumerate(zip(order, low, strict=True)):
            leaf |= side.astype(np.int64).reshape([-1 if i == d else 1 for i in range(len(u))]) << int(k)
        tables[u] += alpha * np.array(tree.leaves)[leaf]
    for c in model.corrections:
        raws = [model.axes[a].raw for a in c.axes]
        order = np.argsort(raws)
        u = tuple(sorted(raws))
        values = np.transpose(c.values, order)[np.ix_(*[axes[r].bin_of_cell() for r in u])]
        tables[u] = tables.get(u, np.zeros(values.shape)) + values
    return tables, boxes


def shed(tables: dict, boxes: dict, weights: dict[int, np.ndarray], axes: dict[int, MergedAxis]) -> None:
    """Centres every box along each feature in turn and adds what that takes off to the pair tables."""
    for u, own in boxes.items():
        for box in own:
            mass = [np.array([weights[r][~low].sum(), weights[r][low].sum()]) for r, low in zip(u, box.low, strict=True)]
            for d in range(3):
                mean = np.tensordot(mass[d], box.octants, (0, d))
                box.octants = box.octants - np.expand_dims(mean, d)
                pair = tuple(r for k, r in enumerate(u) if k != d)
                low = [m for k, m in enumerate(box.low) if k != d]
                if pair not in tables:
                    tables[pair] = np.zeros(tuple(axes[r].cells for r in pair))
                tables[pair] += mean[np.ix_(low[0].astype(int), low[1].astype(int))]


def purify(f0: float, tables: dict[tuple[int, ...], np.ndarray], weights: dict[int, np.ndarray]) -> tuple[float, dict[tuple[int, ...], np.ndarray]]:
    """Moves every weighted slice mean one table down, from triples to pairs to single features to the constant."""
    for order in (3, 2, 1):
        for u in sorted(k for k in tables if len(k) == order):
            for d, r in enumerate(u):
                mean = np.tensordot(weights[r], tables[u], (0, d))
                tables[u] = tables[u] - np.expand_dims(mean, d)
                rest = u[:d] + u[d + 1 :]
                if rest:
                    tables[rest] = tables[rest] + mean if rest in tables else np.asarray(mean)
                else:
                    f0 += float(mean)
    return f0, tables


def cell_counts(cells: DataFrame, columns: list[str]) -> DataFrame:
    """``c.., n``: rows per cell of a table."""
    return cells.groupBy(*columns).agg(F.count("*").alias("n"))


def reference_weights(axes: dict[int, MergedAxis], cells: DataFrame | None = None, laplace: float = 1.0, kind: str = "product") -> dict[int, np.ndarray]:
    """Weight of each cell: uniform, or uniform plus ``laplace`` times its share of the rows, normalised.

    ``cells`` has a column ``c{raw}`` per feature; one aggregate counts all features' cells.
    """
    if kind not in ("product", "uniform"):
        raise InvalidParameter("weights are product or uniform")
    if kind == "uniform" or cells is None:
        return {r: np.full(m.cells, 1 / m.cells) for r, m in axes.items()}
    if not (laplace > 0 and math.isfinite(laplace)):
        raise InvalidParameter("laplace is finite and positive")
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(r).alias("raw"), F.col(f"c{r}").alias("cell")) for r in axes])).alias("e")) if axes else None
    counts = {r: np.zeros(m.cells) for r, m in axes.items()}
    for row in long.groupBy("e.raw", "e.cell").count().collect() if axes else ():  # a row per cell
        counts[row["raw"]][row["cell"]] = row["count"]
    out = {}
    for r, m in axes.items():
        w = 1 / m.cells + laplace * counts[r] / max(counts[r].sum(), 1)
        out[r] = w / w.sum()
    return out


def explain(
    model: Model, cells: DataFrame | None = None, kind: str = "product", laplace: float = 1.0, overflow: str = "factored", check: bool = True, table_cells: int | None = None, spark: SparkSession | None = None
) -> TableBank:
    """The exact tables of a model. ``cells`` are the audit rows as merged cells (see ``score.cell_frame``).

    The raw tables have to give the trees' scores, on the joint cells and on every audit row, before they are purified.
    With ``overflow="sparse"`` triples over ``table_cells`` are written as rows by the session of ``cells`` or ``spark``.
    """
    if not model.exact:
        raise NotExact("an approximate model is not explained")
    axes = merged_axes(model)
    weights = reference_weights(axes, cells, laplace, kind)
    tables, boxes = accumulate(model, axes, overflow, table_cells)
    if check:
        raw_gate(model, TableBank(model.f0, tables, axes, weights, boxes, model.link, model.exact), cells)
    shed(tables, boxes, weights, axes)
    f0, tables = purify(model.f0, tables, weights)
    bank = TableBank(f0, tables, axes, weights, boxes, model.link, model.exact)
    if check:
        run_gates(model, bank)
    if boxes and OVERFLOW[overflow] == "sparse":
        session = cells.sparkSession if cells is not None else spark
        if session is None:
            raise InvalidParameter("sparse tables are written by Spark: pass audit rows or a session")
        bank.stored = {u: stored_rows(session, bank, u) for u in boxes}
    return bank


def stored_rows(spark: SparkSession, bank: TableBank, u: tuple[int, ...], per_task: int = 1 << 20) -> DataFrame:
    """``cell0, cell1, cell2, value`` of the cells of a factored table whose value is not zero, evaluated in tasks and
    written to the shared folder: no task or driver ever holds the table."""
    shape, boxes = tuple(bank.axes[r].cells for r in u), bank.boxes[u]
    total = math.prod(shape)
    ddl = "cell0 int, cell1 int, cell2 int, value double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unravel_index(batch.column(0).to_numpy(), shape)
            value = sum((box.values(at) for box in boxes), np.zeros(batch.num_rows))
            live = value != 0
            yield pa.RecordBatch.from_arrays([*[pa.array(x[live].astype(np.int32)) for x in at], pa.array(value[live])], schema=schema)

    return staged(spark.range(0, total, 1, -(-total // per_task)).mapInArrow(run, ddl), "table-" + "-".join(map(str, u)))


def raw_gate(model: Model, bank: TableBank, cells: DataFrame | None = None) -> float:
    """Largest difference between the trees and the unpurified tables, on the joint cells and in one aggregate over the
    audit rows; raises where it is more than rounding. It tells a fault in adding up from one in purifying."""
    tol = _tolerance(model)
    joint, _ = _joint(bank)
    worst = float(np.abs(model_on_cells(model, bank, joint) - bank.score(joint)).max(initial=0))
    if cells is not None and bank.axes and worst <= tol:
        raws = list(bank.axes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = 0.0
            for batch in batches:
                at = {r: batch.column(k).to_numpy() for k, r in enumerate(raws)}
                found = max(found, float(np.abs(model_on_cells(model, bank, at) - bank.score(at)).max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array([found])], names=["d"])

        own = cells.select(*[F.col(f"c{r}") for r in raws])
        if math.prod(bank.axes[r].cells for r in raws) <= JOINT_CELLS:
            own = own.distinct()  # rows of equal cells differ alike: Python sees each joint cell once, however many rows
        worst = max(worst, own.mapInArrow(run, "d double").agg(F.max("d")).first()[0] or 0.0)
    if not worst <= tol:
        raise InvariantError(f"accumulation: the raw tables differ from the trees by {worst:.3g}, over {tol:.3g}")
    return worst


def _tolerance(model: Model) -> float:
    scale = max(1.0, float(np.abs([model.f0, *[v for _, t in model.trees for v in t.leaves]]).max()))
    return 4 * max(len(model.trees), 1) * float(np.finfo(np.float32).eps) * scale


def _joint(bank: TableBank, rng_seed: int = 0) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Joint cells to check and their weights: all of them if few, else a sample by weight."""
    raws = list(bank.axes)
    total = math.prod(bank.axes[r].cells for r in raws)
    if total <= JOINT_CELLS:
        grid = np.indices([bank.axes[r].cells for r in raws]).reshape(len(raws), -1)
        cells = dict(zip(raws, grid, strict=True))
        return cells, np.prod([bank.weights[r][cells[r]] for r in raws], axis=0) if raws else np.ones(1)
    rng = np.random.default_rng(rng_seed)
    n = 1 << 17
    return {r: rng.choice(bank.axes[r].cells, n, p=bank.weights[r]) for r in raws}, np.full(n, 1 / n)


def model_on_cells(model: Model, bank: TableBank, cells: dict[int, np.ndarray]) -> np.ndarray:
    n = len(next(iter(cells.values()))) if cells else 1
    columns = {m.axis: m.bin_of_cell()[cells[r]] for r, m in bank.axes.items()}
    out = np.full(n, model.f0)
    for alpha, tree in model.trees:
        out += alpha * tree.score(columns)
    for c in model.corrections:
        out += c.values[tuple(columns[a] for a in c.axes)]
    return out


def run_gates(model: Model, bank: TableBank, tolerance: float | None = None) -> dict[str, float]:
    """Checks the decomposition and returns the residual of each gate; raises where one fails.

    feature budget; trees equal tables at every joint cell; the weighted mean is f0; every slice of every table has
    weighted mean 0; the variances of the tables sum to the function's; and f0 plus all attributions is the score.
    """
    model.validate()
    scale = max(1.0, float(np.abs([model.f0, *[v for _, t in model.trees for v in t.leaves]]).max()))
    tol = tolerance if tolerance is not None else _tolerance(model)
    cells, w = _joint(bank)
    exact = math.prod(m.cells for m in bank.axes.values()) <= JOINT_CELLS
    trees, tables = model_on_cells(model, bank, cells), bank.score(cells)
    out = {"reconstruction": float(np.abs(trees - tables).max(initial=0))}
    mean = float((w * trees).sum())
    out["mass"] = abs(mean - bank.f0) if exact else 0.0
    pure = 0.0
    for u, v in bank.tables.items():
        for d, r in enumerate(u):
            pure = max(pure, float(np.abs(np.tensordot(bank.weights[r], v, (0, d))).max(initial=0)))
    for u, own in bank.boxes.items():
        for box in own:
            for d, (r, low) in enumerate(zip(u, box.low, strict=True)):
                mass = np.array([bank.weights[r][~low].sum(), bank.weights[r][low].sum()])
                pure = max(pure, float(np.abs(np.tensordot(mass, box.octants, (0, d))).max()))
    out["purity"] = pure
    spread = float((w * (trees - mean) ** 2).sum())
    shares = sum(bank.variance(u) for u in bank.supports())
    out["variance"] = abs(spread - shares)
    attributed = bank.f0 + sum(bank.shap(cells).values(), np.zeros(len(trees)))
    out["three_way"] = float(np.abs(attributed - trees).max(initial=0))
    limits = {"reconstruction": tol, "mass": tol, "purity": tol, "three_way": tol, "variance": 16 * tol * max(scale, 1) + (0.0 if exact else 0.05 * shares)}
    for gate, residual in out.items():
        if not residual <= limits[gate]:
            raise InvariantError(f"{gate}: residual {residual:.3g} is over {limits[gate]:.3g}")
    return out


def average_banks(banks: list[TableBank], alphas: list[float]) -> tuple[TableBank, dict[tuple[int, ...], np.ndarray]]:
    """Convex average on the union of the members' borders, and a standard-error band per table."""
    if any(b.boxes for b in banks):
        raise NotExact("factored tables cannot be averaged")
    total = sum(alphas)
    share = [a / total for a in alphas]
    axes: dict[int, MergedAxis] = {}
    for b in banks:
        for r, m in b.axes.items():
            if r not in axes:
                axes[r] = MergedAxis(r, m.axis, list(m.cuts), list(m.borders), m.name)
            else:
                merged = sorted({*zip(axes[r].cuts, axes[r].borders, strict=True), *zip(m.cuts, m.borders, strict=True)})
                axes[r].cuts, axes[r].borders = [c for c, _ in merged], [x for _, x in merged]
    weights = {}
    for r, m in axes.items():
        w = np.zeros(m.cells)
        for b, s in zip(banks, share, strict=True):
            own = _member_cells(m, b.axes.get(r))
            part = b.weights[r] if r in b.weights else np.array([0.5, 0.5])
            spread = np.bincount(own, minlength=len(part))
            w += s * part[own] / spread[own]
        weights[r] = w / w.sum()
    members = []
    for b in banks:
        tables = {}
        for u, v in b.tables.items():
            tables[u] = v[np.ix_(*[_member_cells(axes[r], b.axes[r]) for r in u])]
        members.append(purify(b.f0, tables, weights))
    supports = sorted({u for _, t in members for u in t}, key=lambda u: (len(u), u))
    tables, bands = {}, {}
    squares = sum(s * s for s in share)
    for u in supports:
        shape = tuple(axes[r].cells for r in u)
        values = [t.get(u, np.zeros(shape)) for _, t in members]
        tables[u] = sum(s * v for s, v in zip(share, values, strict=True))
        between = sum(s * (v - tables[u]) ** 2 for s, v in zip(share, values, strict=True))
        bands[u] = np.sqrt(np.maximum(between / max(1 - squares, 1e-300), 0)) * math.sqrt(squares) if squares < 1 else np.zeros(shape)
    f0 = sum(s * f for s, (f, _) in zip(share, members, strict=True))
    return TableBank(f0, tables, axes, weights, {}, banks[0].link, all(b.exact for b in banks)), bands


def _member_cells(union: MergedAxis, member: MergedAxis | None) -> np.ndarray:
    """The member's cell of each cell of the union grid."""
    if member is None:
        return np.array([0] + [1] * (union.cells - 1))
    return np.array([0, *[1 + int(np.searchsorted(member.borders, x, side="left")) for x in union.borders], member.cells - 1])
