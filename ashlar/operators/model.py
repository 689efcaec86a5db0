"""The fitted model, its parts, its checks, and the errors they raise."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .encode import CatEncoder

FORMAT_VERSION = 1


class ModelError(ValueError):
    """Base of this library's model errors."""


class SchemaMismatch(ModelError):
    """Data whose columns or grids are not the model's."""


class InvalidParameter(ModelError):
    """A parameter outside its range, or a combination that is not allowed."""


class BudgetExceeded(ModelError):
    """A table larger than its cell budget."""


class NotExact(ModelError):
    """An approximate model has no exact tables to export."""


class InvariantError(ModelError):
    """A decomposition that fails one of its gates."""


@dataclass(frozen=True)
class Split:
    """Low if the bin is at most ``bin_le``; the missing bin 0 goes low where ``missing_left``."""

    axis: int
    bin_le: int
    missing_left: bool = False

    def low(self, bins: np.ndarray) -> np.ndarray:
        return np.where(bins == 0, self.missing_left, bins <= self.bin_le)


@dataclass(frozen=True)
class Tree:
    """One test per level; the leaf's bit of a level is 1 on the low side."""

    splits: tuple[Split, ...]
    leaves: tuple[float, ...]

    def leaf(self, columns: dict[int, np.ndarray] | list[np.ndarray]) -> np.ndarray:
        out = 0
        for level, split in enumerate(self.splits):
            out = out | (split.low(columns[split.axis]).astype(np.int64) << level)
        return np.asarray(out)

    def score(self, columns) -> np.ndarray:
        return np.array(self.leaves)[self.leaf(columns)]


@dataclass
class Axis:
    """A binned column: its raw feature, borders, and encoder if it is categorical."""

    raw: int
    name: str
    borders: np.ndarray
    encoder: CatEncoder | None = None

    @property
    def data_bins(self) -> int:
        return len(self.borders) + 1


@dataclass
class Correction:
    """Additive values per cell of one or two axes, cells being bins."""

    axes: tuple[int, ...]
    values: np.ndarray


@dataclass
class Model:
    f0: float
    trees: list[tuple[float, Tree]]
    axes: list[Axis]
    objective: str = "squared_error"
    link: str = "identity"
    tweedie_rho: float = 1.5
    exact: bool = True
    corrections: list[Correction] = field(default_factory=list)
    class_labels: list = field(default_factory=list)
    version: int = FORMAT_VERSION

    def raw_score(self, columns) -> np.ndarray:
        """f0 + sum of alpha * leaf + corrections, for bin columns of equal length; without offset."""
        n = len(columns[0]) if len(self.axes) else 0
        out = np.full(n, self.f0)
        for alpha, tree in self.trees:
            out += alpha * tree.score(columns)
        for c in self.corrections:
            out += c.values[tuple(columns[a] for a in c.axes)]
        return out

    def validate(self) -> None:
        """Raises unless the model is well formed."""
        if self.version != FORMAT_VERSION:
            raise ModelError(f"format version {self.version} is not {FORMAT_VERSION}")
        if not math.isfinite(self.f0):
            raise ModelError("f0 is not finite")
        links = {"squared_error": "identity", "logistic": "logit"}
        if links.get(self.objective, "log") != self.link:
            raise ModelError(f"{self.objective} does not go with the {self.link} link")
        for axis in self.axes:
            if len(axis.borders) > 253 or not np.isfinite(axis.borders).all() or (np.diff(axis.borders) <= 0).any():
                raise ModelError(f"borders of {axis.name} are not finite and ascending, or too many")
        for alpha, tree in self.trees:
            raws = {self.axes[s.axis].raw for s in tree.splits if 0 <= s.axis < len(self.axes)}
            if not 1 <= len(tree.splits) <= 3 or len(raws) != len(tree.splits):
                raise ModelError("a tree tests one to three distinct features")
            if len(tree.leaves) != 1 << len(tree.splits) or not np.isfinite([alpha, *tree.leaves]).all():
                raise ModelError("a tree has one finite value per leaf")
            if any(not 1 <= s.bin_le < self.axes[s.axis].data_bins for s in tree.splits):
                raise ModelError("a split lies between two data bins")
        for c in self.corrections:
            if not 1 <= len(c.axes) <= 3 or c.values.shape != tuple(self.axes[a].data_bins + 1 for a in c.axes) or not np.isfinite(c.values).all():
                raise ModelError("a correction has one finite value per cell")
