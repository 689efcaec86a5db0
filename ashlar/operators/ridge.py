"""Ridge systems over rows that stand in one cell of each of several groups, such as leaves of trees or cells of tables.

The unknowns are one value per cell. What couples two cells is the weight of the rows that stand in both. Where the groups
are small those sums are gathered once, as sparse rows, and the system is solved on them; otherwise nothing larger than
one number per cell ever leaves a task, and each step of a conjugate gradient is one job over the stored rows. Both take
the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_schema
from .histogram import DECIMAL

#: Pairs of cells up to which their sums are gathered; a task holds one number for each.
JOINT_PAIRS = 1 << 22

#: From a batch's columns: the cell within each group, the gradient and the weight of each row.
Cells = Callable[[dict[str, np.ndarray]], tuple[list[np.ndarray], np.ndarray, np.ndarray]]


@dataclass
class RidgeSystem:
    """``sum h/2 (sum_u scale_u v[cell_u])^2 + g sum_u scale_u v[cell_u] + penalty/2 |v|^2`` over stored ``rows``."""

    rows: DataFrame
    sizes: list[int]
    cells: Cells
    scale: np.ndarray
    jobs: int = 0
    _sums: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    _pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    def _summed(self, count: int, add: Callable[[dict[str, np.ndarray], list[np.ndarray]], None], columns: int = 1) -> np.ndarray:
        """``[column, cell]``: what ``add`` puts together in each task, summed over tasks as decimals in one job."""
        names = [f"v{k}" for k in range(columns)]
        ddl = "cell int, " + ", ".join(f"{n} double" for n in names)
        schema = arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(count) for _ in names]
            for batch in batches:
                if batch.num_rows:
                    add({n: x.to_numpy(zero_copy_only=False) for n, x in zip(batch.schema.names, batch.columns, strict=True)}, total)
            live = np.flatnonzero(np.any([t != 0 for t in total], axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *[pa.array(t[live]) for t in total]], schema=schema)

        self.jobs += 1
        table = self.rows.mapInArrow(run, ddl).groupBy("cell").agg(*[F.sum(F.col(n).cast(DECIMAL)).cast("double").alias(n) for n in names]).toArrow()
        out = np.zeros((columns, count))
        at = table.column("cell").to_numpy()
        for k, n in enumerate(names):
            out[k, at] = table.column(n).to_numpy()
        return out

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Right-hand side and diagonal: minus the gradient, and the weight, of each cell."""
        if self._sums is None:
            starts, width, cells, scale = self.starts, int(self.starts[-1]), self.cells, self.scale

            def add(data: dict[str, np.ndarray], total: list[np.ndarray]) -> None:
                at, g, h = cells(data)
                for u, own in enumerate(at):
                    total[0] += np.bincount(starts[u] + own, -scale[u] * g, width)
                    total[1] += np.bincount(starts[u] + own, scale[u] ** 2 * h, width)

            self._sums = tuple(self._summed(width, add, 2))
        return self._sums

    def _pair_layout(self) -> list[tuple[int, int, int]]:
        """Pairs of groups with the place of their first pair of cells."""
        out, at = [], 0
        for u, a in enumerate(self.sizes):
            for v in range(u + 1, len(self.sizes)):
                out.append((u, v, at))
                at += a * self.sizes[v]
        return out

    def joint(self) -> bool:
        total = sum(self.sizes)
        return (total * total - sum(s * s for s in self.sizes)) // 2 <= JOINT_PAIRS

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(cell, cell, weight)`` of the cells of unlike groups that rows share."""
        if self._pairs is None:
            layout, sizes, cells, scale, starts = self._pair_layout(), self.sizes, self.cells, self.scale, self.starts
            count = layout[-1][2] + sizes[layout[-1][0]] * sizes[layout[-1][1]] if layout else 0

            def add(data: dict[str, np.ndarray], total: list[np.ndarray]) -> None:
                at, _, h = cells(data)
                for u, v, first in layout:
                    size = sizes[u] * sizes[v]
                    total[0][first : first + size] += np.bincount(at[u] * sizes[v] + at[v], scale[u] * scale[v] * h, size)

            weight = self._summed(count, add)[0] if count else np.zeros(0)
            place = np.flatnonzero(weight)
            firsts = np.array([first for *_, first in layout], np.int64)
            which = np.searchsorted(firsts, place, side="right") - 1
            us, vs = (np.array([x[k] for x in layout], np.int64)[which] for k in (0, 1)) if layout else (place, place)
            inside = place - firsts[which] if layout else place
            wide = np.array(sizes, np.int64)[vs] if layout else np.ones(0, np.int64)
            self._pairs = (starts[us] + inside // wide, starts[vs] + inside % wide, weight[place])
        return self._pairs

    def times(self, v: np.ndarray) -> np.ndarray:
        """The coupling matrix times ``v``: on the sums, or as one job."""
        if self.joint():
            a, b, weight = self.pairs()
            out = self.sums()[1] * v
            out += np.bincount(a, weight * v[b], len(v))
            return out + np.bincount(b, weight * v[a], len(v))
        starts, cells, scale = self.starts, self.cells, self.scale

        def add(data: dict[str, np.ndarray], total: list[np.ndarray]) -> None:
            at, _, h = cells(data)
            whole = h * sum(scale[u] * v[starts[u] + own] for u, own in enumerate(at))
            for u, own in enumerate(at):
                total[0] += np.bincount(starts[u] + own, scale[u] * whole, len(v))

        return self._summed(len(v), add)[0]

    def solve(self, penalty: np.ndarray, start: np.ndarray | None = None, pull: np.ndarray | None = None, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
        """The minimum by a conjugate gradient that starts at ``start`` and is scaled by the diagonal.

        ``pull`` is added to the right-hand side. Cells without rows end at zero where nothing pulls them.
        """
        right, diagonal = self.sums()
        right = right if pull is None else right + pull
        scale = diagonal + penalty
        x = np.zeros(len(right)) if start is None else start.copy()
        rest = right - (self.times(x) + penalty * x if x.any() else 0)
        aim = tolerance * max(float(np.linalg.norm(right)), 1e-300)
        z = rest / scale
        direction, size = z, rest @ z
        for _ in range(steps):
            if np.linalg.norm(rest) <= aim or size <= 0:
                break
            moved = self.times(direction) + penalty * direction
            length = size / (direction @ moved)
            x = x + length * direction
            rest = rest - length * moved
            z = rest / scale
            size, before = rest @ z, size
            direction = z + size / before * direction
        return x
