"""Objectives as Column expressions: gradient, hessian, start score, deviance, link."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
HESSIAN_FLOOR = 1e-16
EXP_CLAMP = 30.0
PROBABILITY_FLOOR = 1e-12


class LossError(ValueError):
    """A target, weight or parameter outside the objective's domain."""


def clamped_exp(f: Column) -> Column:
    return F.exp(F.greatest(F.least(f, F.lit(EXP_CLAMP)), F.lit(-EXP_CLAMP)))


def sigmoid(f: Column) -> Column:
    """Stable on both sides: the exponent is never positive."""
    e = F.exp(-F.abs(f))
    return F.when(f >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


@dataclass(frozen=True)
class Loss:
    """Base of the objectives. ``y``, ``f`` and ``w`` are double columns: target, raw score and weight."""

    name: str = "squared_error"
    link: str = "identity"
    max_delta_step: float = 0.0

    def gradient(self, y: Column, f: Column, w: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def deviance_terms(self, y: Column, f: Column, w: Column) -> Column:
        raise NotImplementedError

    def in_domain(self, y: Column) -> Column:
        return ~F.isnan(y) & (F.abs(y) < float("inf"))

    def numpy_gradient(self, y: np.ndarray, f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def numpy_deviance(self, y: np.ndarray, f: np.ndarray, w: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def inverse_link(self, f: Column) -> Column:
        return {"identity": lambda x: x, "log": clamped_exp, "logit": sigmoid}[self.link](f)

    def numpy_inverse_link(self, f: np.ndarray) -> np.ndarray:
        if self.link == "identity":
            return f
        if self.link == "log":
            return np.exp(np.clip(f, -EXP_CLAMP, EXP_CLAMP))
        e = np.exp(-np.abs(f))
        return np.where(f >= 0, 1 / (1 + e), e / (1 + e))

    def start_score(self, df: DataFrame, y: str = "y", w: str = "w", off: str = "off") -> float:
        """The constant with the least deviance over all rows, one aggregate."""
        weight, offset = F.col(w), F.col(off)
        row = df.agg(
            F.sum(weight).alias("w"), F.sum(weight * F.col(y)).alias("wy"), F.sum(weight * (F.col(y) - offset)).alias("wd"), F.sum(weight * F.exp(offset)).alias("we")
        ).first()
        return self.start_from(*row)

    def start_from(self, w: float, wy: float, wd: float, we: float) -> float:
        """The same from the sums of weights, weighted targets, targets less offsets, and exponentials of offsets."""
        if not w or w <= 0:
            raise LossError("weights sum to zero")
        if self.link == "identity":
            return wd / w
        if self.link == "log":
            return math.log(max(wy / we, PROBABILITY_FLOOR))
        p = wy / w
        if not 0 < p < 1:
            raise LossError("both classes are needed")
        return math.log(p / (1 - p))

    def checked(self, df: DataFrame, y: str = "y", w: str = "w") -> None:
        """Raises unless every target is in the domain and every weight finite and not negative; one aggregate."""
        bad_w = F.isnan(w) | (F.col(w) < 0) | (F.col(w) == float("inf"))
        row = df.agg(F.sum((~F.coalesce(self.in_domain(F.col(y)), F.lit(False))).cast("int")), F.sum(F.coalesce(bad_w, F.lit(True)).cast("int"))).first()
        if row[0] or row[1]:
            raise LossError(f"{row[0]} targets are outside the domain of {self.name} and {row[1]} weights are invalid")

    def deviance(self, df: DataFrame, y: str = "y", f: str = "f", w: str = "w") -> float:
        """Sum of the deviance terms."""
        return df.agg(F.sum(self.deviance_terms(F.col(y), F.col(f), F.col(w)))).first()[0]


def _floor(h: Column) -> Column:
    return F.greatest(h, F.lit(HESSIAN_FLOOR))


def _x_log_ratio(x: Column, ratio: Column) -> Column:
    """``x * ln(ratio)``, 0 where x is 0."""
    return F.when(x > 0, x * F.log(F.when(x > 0, ratio).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))


class SquaredError(Loss):
    def __init__(self) -> None:
        super().__init__("squared_error", "identity")

    def gradient(self, y, f, w):
        return w * (f - y), _floor(w)

    def deviance_terms(self, y, f, w):
        return F.lit(0.5) * w * (f - y) * (f - y)

    def numpy_gradient(self, y, f, w):
        return w * (f - y), np.maximum(w, HESSIAN_FLOOR)

    def numpy_deviance(self, y, f, w):
        return 0.5 * w * (f - y) ** 2


class Logistic(Loss):
    def __init__(self) -> None:
        super().__init__("logistic", "logit")

    def in_domain(self, y):
        return (y >= 0) & (y <= 1)

    def gradient(self, y, f, w):
        p = sigmoid(f)
        return w * (p - y), _floor(w * p * (1 - p))

    def deviance_terms(self, y, f, w):
        p = F.greatest(F.least(sigmoid(f), F.lit(1 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))
        return 2 * w * (_x_log_ratio(y, y / p) + _x_log_ratio(1 - y, (1 - y) / (1 - p)))

    def numpy_gradient(self, y, f, w):
        p = self.numpy_inverse_link(f)
        return w * (p - y), np.maximum(w * p * (1 - p), HESSIAN_FLOOR)

    def numpy_deviance(self, y, f, w):
        p = np.clip(self.numpy_inverse_link(f), PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
        a = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / p), 0)
        b = np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / (1 - p)), 0)
        return 2 * w * (a + b)


class Poisson(Loss):
    def __init__(self) -> None:
        super().__init__("poisson", "log", 0.7)

    def in_domain(self, y):
        return (y >= 0) & (y < float("inf"))

    def gradient(self, y, f, w):
        mu = clamped_exp(f)
        return w * (mu - y), _floor(w * mu)

    def deviance_terms(self, y, f, w):
        mu = clamped_exp(f)
        return 2 * w * (_x_log_ratio(y, y / mu) - (y - mu))

    def numpy_gradient(self, y, f, w):
        mu = self.numpy_inverse_link(f)
        return w * (mu - y), np.maximum(w * mu, HESSIAN_FLOOR)

    def numpy_deviance(self, y, f, w):
        mu = self.numpy_inverse_link(f)
        return 2 * w * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))


class Gamma(Loss):
    def __init__(self) -> None:
        super().__init__("gamma", "log")

    def in_domain(self, y):
        return (y > 0) & (y < float("inf"))

    def gradient(self, y, f, w):
        ratio = y * clamped_exp(-f)
        return w * (1 - ratio), _floor(w * ratio)

    def deviance_terms(self, y, f, w):
        ratio = y / clamped_exp(f)
        return 2 * w * (ratio - 1 - F.log(ratio))

    def numpy_gradient(self, y, f, w):
        ratio = y * np.exp(np.clip(-f, -EXP_CLAMP, EXP_CLAMP))
        return w * (1 - ratio), np.maximum(w * ratio, HESSIAN_FLOOR)

    def numpy_deviance(self, y, f, w):
        ratio = y / self.numpy_inverse_link(f)
        return 2 * w * (ratio - 1 - np.log(ratio))


class Tweedie(Loss):
    def __init__(self, rho: float = 1.5) -> None:
        if not 1 < rho < 2:
            raise LossError("the power lies between 1 and 2")
        super().__init__("tweedie", "log")
        object.__setattr__(self, "rho", rho)

    def in_domain(self, y):
        return (y >= 0) & (y < float("inf"))

    def gradient(self, y, f, w):
        a, b = 1 - self.rho, 2 - self.rho
        ea, eb = clamped_exp(a * f), clamped_exp(b * f)
        return w * (eb - y * ea), _floor(w * (b * eb - y * a * ea))

    def deviance_terms(self, y, f, w):
        a, b = 1 - self.rho, 2 - self.rho
        mu = clamped_exp(f)
        return 2 * w * (F.pow(y, F.lit(b)) / (a * b) - y * F.pow(mu, F.lit(a)) / a + F.pow(mu, F.lit(b)) / b)

    def numpy_gradient(self, y, f, w):
        a, b = 1 - self.rho, 2 - self.rho
        ea, eb = np.exp(np.clip(a * f, -EXP_CLAMP, EXP_CLAMP)), np.exp(np.clip(b * f, -EXP_CLAMP, EXP_CLAMP))
        return w * (eb - y * ea), np.maximum(w * (b * eb - y * a * ea), HESSIAN_FLOOR)

    def numpy_deviance(self, y, f, w):
        a, b = 1 - self.rho, 2 - self.rho
        mu = self.numpy_inverse_link(f)
        return 2 * w * (y**b / (a * b) - y * mu**a / a + mu**b / b)


#: Accepted names of each objective.
NAMES = {
    "squared_error": SquaredError, "squarederror": SquaredError, "l2": SquaredError, "regression": SquaredError,
    "logistic": Logistic, "binary_logloss": Logistic, "log_loss": Logistic, "classifier": Logistic,
    "poisson": Poisson, "gamma": Gamma, "tweedie": Tweedie,
}


def loss_by_name(name: str | None, tweedie_rho: float = 1.5) -> Loss:
    """Objective by any of its names, whatever the case; None is squared error."""
    found = NAMES.get((name or "squared_error").lower())
    if found is None:
        raise LossError(f"unknown objective {name!r}")
    return found(tweedie_rho) if found is Tweedie else found()
