"""Scoring: by trees over binned rows, and by tables over merged cells. Neither keeps state; only tables too large to be
broadcast, where they are joined, shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from .explain import TableBank
from .grids import bin_expression, bins
from .model import Axis, Model, SchemaMismatch

# Fixed value: borders up to which a column is binned by cases in the JVM.
FEW_BORDERS = 16


def _plain(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def bin_column(axis: Axis, column: pa.Array) -> np.ndarray:
    """Serve-time bins of one column: frozen encoding if it is categorical, then the frozen borders."""
    if axis.encoder is None:
        return bins(_plain(column), axis.borders)
    codes = column.cast(pa.string()).dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    table = np.array([axis.encoder.encode(x) for x in codes.dictionary.to_pylist()] + [axis.encoder.encode(None)])
    at = codes.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)
    return bins(table[at], axis.borders)


def _check_columns(df: DataFrame, axes: list[Axis]) -> None:
    missing = [a.name for a in axes if a.name not in df.columns]
    if missing:
        raise SchemaMismatch(f"columns {missing} are missing")


def binned_frame(df: DataFrame, axes: list[Axis], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and a bin column ``b{i}`` per axis, read from the column of the axis's name.

    Numbers with few borders are binned by cases in the JVM, so that reading the rows again takes no Python worker; all
    else in one Arrow pass. The rule is the same.
    """
    _check_columns(df, axes)
    numbers = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)
    if all(a.encoder is None and len(a.borders) <= FEW_BORDERS and isinstance(df.schema[a.name].dataType, numbers) for a in axes):
        return df.select(*keep, *[bin_expression(F.col(a.name).cast("float").cast("double"), a.borders).alias(f"b{i}") for i, a in enumerate(axes)])
    own = df.select(*keep, *[F.col(a.name).alias(f"_x{i}") for i, a in enumerate(axes)])
    schema = StructType([*[own.schema[c] for c in keep], *[StructField(f"b{i}", ShortType()) for i in range(len(axes))]])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(bin_column(a, batch.column(len(keep) + i))) for i, a in enumerate(axes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names=names)

    return own.mapInArrow(run, schema)


def predict(df: DataFrame, model: Model, keep: list[str] | None = None, raw: str = "raw_score", response: str = "prediction", offset: str | None = None) -> DataFrame:
    """Adds the raw score and the response to the rows: one Arrow pass with the model in it; fit for streams."""
    _check_columns(df, model.axes)
    keep = df.columns if keep is None else keep
    source = [*keep, *[a.name for a in model.axes if a.name not in keep], *([offset] if offset and offset not in keep else [])]
    own = df.select(*source)
    schema = StructType([*[own.schema[c] for c in keep], StructField(raw, DoubleType()), StructField(response, DoubleType())])
    names, link = [f.name for f in schema], model.link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.raw_score([bin_column(a, batch.column(a.name)) for a in model.axes])
            if len(score) != batch.num_rows:
                score = np.full(batch.num_rows, model.f0)
            if offset:
                score = score + _plain(batch.column(offset))
            if link == "identity":
                out = score
            elif link == "log":
                out = np.exp(np.clip(score, -30, 30))
            else:
                e = np.exp(-np.abs(score))
                out = np.where(score >= 0, 1 / (1 + e), e / (1 + e))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score), pa.array(out)], names=names)

    return own.mapInArrow(run, schema)


def cell_frame(binned: DataFrame, bank_axes: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the merged cell ``c{raw}`` of each feature, by a lookup on its bin."""
    out = []
    for r, m in bank_axes.items():
        bin_ = F.col(f"b{m.axis}")
        cell = F.when(bin_ == 0, F.lit(0))
        for k, cut in enumerate(m.cuts):
            cell = cell.when(bin_ <= cut, F.lit(k + 1))
        out.append(cell.otherwise(F.lit(len(m.cuts) + 1)).cast("int").alias(f"c{r}"))
    return binned.select(*keep, *out)


def table_scores(cells: DataFrame, bank: TableBank, key: str) -> DataFrame:
    """``key, raw_score`` by looking every table up, with no join and no shuffle: as array lookups in the JVM where all
    tables are small and dense, otherwise in one Arrow pass with the bank in it."""
    if bank.boxes or any(v.size > 4096 for v in bank.tables.values()):
        return bank_scores(cells, bank, [key])
    total = F.lit(bank.f0)
    for u, v in sorted(bank.tables.items(), key=lambda x: (len(x[0]), x[0])):
        at = F.lit(0)
        for d, r in enumerate(u):
            at = at * v.shape[d] + F.col(f"c{r}")
        total = total + F.element_at(F.array(*[F.lit(float(x)) for x in v.ravel()]), at + 1)
    return cells.select(key, total.alias("raw_score"))


def bank_scores(cells: DataFrame, bank: TableBank, keep: list[str], shares: bool = False, interactions: tuple[tuple[int, ...], ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``raw_score`` of rows of merged cells, in one Arrow pass with the bank in it.

    ``shares`` adds ``phi{raw}``, each feature's attribution; ``interactions`` adds ``inter_{raw}_{raw}`` for sets of
    features. A bank is bounded by its cell budgets, and tables over them are evaluated box by box, so no row needs more
    than its own cells, however many features there are.
    """
    raws = list(bank.axes)
    own = cells.select(*keep, *[F.col(f"c{r}").alias(f"_c{r}") for r in raws])
    names = ["raw_score", *[f"phi{r}" for r in raws if shares], *["inter_" + "_".join(map(str, sorted(u))) for u in interactions]]
    schema = StructType([*[own.schema[c] for c in keep], *[StructField(n, DoubleType()) for n in names]])
    columns = [f.name for f in schema]
    # rows of the tables stay behind: they belong to the driver's session
    small = replace(bank, stored={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {r: batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k, r in enumerate(raws)}
            found = [small.score(at) if raws else np.full(batch.num_rows, small.f0)]
            if shares:
                own_shares = small.shap(at) if raws else {}
                found += [own_shares[r] for r in raws]
            found += [small.faith_shap(u, at) for u in interactions]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(x) for x in found]], names=columns)

    return own.mapInArrow(run, schema)


def attributions(cells: DataFrame, bank: TableBank, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``raw_score`` and ``phi{raw}`` of each feature: with f0 they add up to the score."""
    return bank_scores(cells, bank, keep, shares=True)


def effect_rows(bank: TableBank, u: tuple[int, ...]) -> pa.Table:
    """``cell0.., value`` of every cell of a dense table."""
    v = bank.tables[u]
    at = np.indices(v.shape, np.int32).reshape(v.ndim, -1)
    return pa.table({**{f"cell{d}": at[d] for d in range(v.ndim)}, "value": v.ravel().astype(float)})


def joined_scores(cells: DataFrame, bank: TableBank, key: str) -> DataFrame:
    """``key, raw_score`` by joining each table's effects on its cells and summing: the warehouse recipe.

    The rows are read once, and each table adds its effect to them; a cell that a table does not hold adds nothing. Tables
    that were written as rows are joined from there; boxes that were not cannot be joined.
    """
    if set(bank.boxes) - set(bank.stored):
        raise SchemaMismatch("factored tables are joined once they are written as rows: overflow='sparse'")
    spark, total, out = cells.sparkSession, F.lit(bank.f0), cells
    for i, (u, _) in enumerate(bank.sobol()):
        # from Arrow the effects are local rows of known size, which Spark broadcasts where they are small enough
        own = bank.stored[u] if u in bank.stored else spark.createDataFrame(effect_rows(bank, u))
        own = own.select(*[F.col(f"cell{d}").alias(f"_t{i}_{d}") for d in range(len(u))], F.col("value").alias(f"_v{i}"))
        out = out.join(own, [F.col(f"c{r}") == F.col(f"_t{i}_{d}") for d, r in enumerate(u)], "left").drop(*[f"_t{i}_{d}" for d in range(len(u))])
        total = total + F.coalesce(F.col(f"_v{i}"), F.lit(0.0))
    return out.select(key, total.alias("raw_score"))
