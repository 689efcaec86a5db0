"""Regressor and classifier over DataFrames: fit, predict, tables, JSON."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import export, score
from .operators.boost import BoostConfig, Booster
from .operators.encode import EncodeConfig, fit_encoder
from .operators.explain import TableBank, explain, merged_axes
from .operators.grids import GridConfig, build_grid
from .operators.model import Axis, InvalidParameter, Model
from .operators.refit import CellRefit, Selection, fit_model
from .operators.split import SplitConfig
from .session import staged
from .sources.frames import column_kinds, training_rows


class BoostedRegressor:
    """Depth-three symmetric trees on binned columns, with exact tables.

    ``key`` names a unique integer column: folds, samples and hold-outs key on it, so results do not depend on the
    partitioning. Knobs not named here are fields of ``BoostConfig`` and ``SplitConfig``. With ``n_bags`` bags are
    averaged, and ``cell_refit`` corrects the average on what the bags left out; with ``selection`` the settings of a grid
    are fitted and the best mixture of them is kept.
    """

    def __init__(self, key: str, features: list[str], objective: str = "squared_error", categorical: list | None = None, monotone: dict[str, int] | list[int] | None = None, max_bin: int = 254, encode: EncodeConfig = EncodeConfig(), tweedie_rho: float = 1.5, cell_refit: CellRefit | None = None, selection: Selection | None = None, **knobs) -> None:
        names = SplitConfig.__dataclass_fields__
        self.split = SplitConfig(**{k: v for k, v in knobs.items() if k in names})
        self.config = BoostConfig(**{k: v for k, v in knobs.items() if k not in names})
        self.key, self.features, self.objective, self.categorical = key, features, objective, categorical
        self.monotone = dict(zip(features, monotone, strict=True)) if isinstance(monotone, list) else dict(monotone or {})
        self.grid, self.encode, self.rho = GridConfig(max_bin), encode, tweedie_rho
        self.cell_refit, self.selection = cell_refit, selection
        if cell_refit is not None and self.config.n_bags < 2:
            raise InvalidParameter("a cell refit needs n_bags >= 2, for residuals that no tree has seen")
        if any(v not in (-1, 0, 1) for v in self.monotone.values()) or set(self.monotone) - set(features):
            raise InvalidParameter("monotone constraints are -1, 0 or 1 for known features")
        self.model: Model | None = None

    def _target(self, df: DataFrame, y: str) -> tuple[DataFrame, list]:
        return df, []

    def fit(self, df: DataFrame, y: str, weight: str | None = None, exposure: str | None = None) -> BoostedRegressor:
        numeric, categorical = column_kinds(df, self.features, self.categorical)
        if categorical and self.config.validation_fraction and self.encode.leakage != "kfold":
            raise InvalidParameter("categorical features with a validation fraction need k-fold encodings")
        df, labels = self._target(df, y)
        rows = training_rows(df, self.key, self.features, y, weight, exposure)
        rows = staged(rows.select("rid", *[F.col(c) if c in numeric else F.col(c).cast("string") for c in self.features], "y", "w", "off"), "training")
        order = [*numeric, *categorical]
        axes, binned = [], None
        for i, name in enumerate(order):
            raw = self.features.index(name)
            if name in numeric:
                axes.append(Axis(raw, name, build_grid(rows, name, None if weight is None else "w", self.grid)))
                continue
            encoder, enc = fit_encoder(rows, name, "y", "rid", self.encode, self.config.seed, F.col("w"), F.exp("off"))
            import numpy as np

            axes.append(Axis(raw, name, np.array(encoder.borders), encoder))
            rows = rows.join(enc.select(F.col("key").alias("rid"), F.col("enc").alias(f"_enc{i}")), "rid")
        # trees grow on the out-of-fold encodings, cut by the frozen grid
        train_axes = [Axis(a.raw, a.name if a.encoder is None else f"_enc{i}", a.borders) for i, a in enumerate(axes)]
        binned = score.binned_frame(rows, train_axes, ["rid", "y", "w", "off"])
        signs = {i: self.monotone[a.name] for i, a in enumerate(axes) if self.monotone.get(a.name)}
        config = replace(self.config, split=replace(self.split, monotone=signs))
        self.model = fit_model(Booster(axes, self.objective, config, self.rho), binned, self.cell_refit, self.selection)
        self.model.class_labels = labels
        return self

    def _fitted(self) -> Model:
        if self.model is None:
            raise InvalidParameter("the estimator is not fitted")
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with ``raw_score`` and ``prediction``."""
        return score.predict(df, self._fitted())

    def predict_raw(self, df: DataFrame) -> DataFrame:
        return self.predict(df).drop("prediction")

    def cells(self, df: DataFrame) -> DataFrame:
        model = self._fitted()
        return score.cell_frame(score.binned_frame(df, model.axes, [self.key]), merged_axes(model), [self.key])

    def tables(self, df: DataFrame | None = None, ref_measure: str = "product", laplace: float = 1.0, overflow: str = "factored") -> TableBank:
        """The exact tables, weighted by the audit rows ``df``."""
        kind = {"product": "product", "product_marginals": "product", "uniform": "uniform"}.get(ref_measure)
        if kind is None:
            raise InvalidParameter(f"unknown reference measure {ref_measure!r}")
        return explain(self._fitted(), None if df is None else self.cells(df), kind, laplace, overflow, spark=None if df is None else df.sparkSession)

    def explain_rows(self, df: DataFrame, bank: TableBank, keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` (the key) with the raw score and each feature's attribution ``phi_{name}``."""
        model, keep = self._fitted(), keep or [self.key]
        cells = score.cell_frame(score.binned_frame(df, model.axes, keep), merged_axes(model), keep)
        out = score.attributions(cells, bank, keep)
        return out.withColumnsRenamed({f"phi{r}": f"phi_{m.name}" for r, m in bank.axes.items()})

    def to_json(self) -> str:
        return export.to_json(self._fitted())

    def from_json(self, text: str) -> BoostedRegressor:
        self.model = export.from_json(text)
        return self


class BoostedClassifier(BoostedRegressor):
    """Two classes, in ascending order of their label."""

    def __init__(self, key: str, features: list[str], **knobs) -> None:
        super().__init__(key, features, objective="logistic", **knobs)

    def _target(self, df: DataFrame, y: str) -> tuple[DataFrame, list]:
        labels = sorted(r[0] for r in df.select(y).distinct().limit(3).collect())
        if len(labels) != 2:
            raise InvalidParameter("exactly two classes are needed")
        return df.withColumn(y, (F.col(y) == F.lit(labels[1])).cast("double")), labels

    def predict_proba(self, df: DataFrame) -> DataFrame:
        out = self.predict(df)
        return out.withColumns({"p0": 1 - F.col("prediction"), "p1": F.col("prediction")})

    def predict_label(self, df: DataFrame) -> DataFrame:
        low, high = self._fitted().class_labels
        return self.predict(df).withColumn("label", F.when(F.col("prediction") >= 0.5, F.lit(high)).otherwise(F.lit(low)))
