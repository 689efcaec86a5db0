"""Reading rows for a fit: column kinds, the float width of features, and the claims join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..operators.model import SchemaMismatch


def column_kinds(df: DataFrame, features: list[str], categorical: list[str | int] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features. Categorical ones are named, numbered or masked, or are those not numeric."""
    if categorical is not None and len(categorical) == len(features) and all(isinstance(c, bool) for c in categorical):
        chosen = {f for f, c in zip(features, categorical, strict=True) if c}
    else:
        chosen = {features[c] if isinstance(c, int) else c for c in categorical or ()}
    unknown = chosen - set(features)
    if unknown:
        raise SchemaMismatch(f"{sorted(unknown)} are not features")
    types = {f.name: f.dataType for f in df.schema}
    absent = [f for f in features if f not in types]
    if absent:
        raise SchemaMismatch(f"columns {absent} are missing")
    if categorical is None:
        chosen = {f for f in features if not isinstance(types[f], (NumericType, BooleanType))}
    return [f for f in features if f not in chosen], [f for f in features if f in chosen]


def training_rows(df: DataFrame, key: str, features: list[str], y: str, weight: str | None = None, exposure: str | None = None) -> DataFrame:
    """``rid, features.., y, w, off`` with float features; the offset is the log of the exposure.

    Only these columns are read. The key tells rows apart, so it has to be unique.
    """
    off = F.lit(0.0) if exposure is None else F.log(F.col(exposure).cast("double"))
    if exposure is not None:
        e = F.col(exposure).cast("double")
        bad = df.where(e.isNull() | F.isnan(e) | (e <= 0) | (e == float("inf"))).limit(1).count()
        if bad:
            raise SchemaMismatch("exposures are finite and positive")
    types = {f.name: f.dataType for f in df.schema}
    xs = [F.col(f).cast("float").alias(f) if isinstance(types[f], (NumericType, BooleanType)) else F.col(f) for f in features]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(F.col(key).cast("long").alias("rid"), *xs, F.col(y).cast("double").alias("y"), w.alias("w"), off.alias("off"))


def claims_frame(policies: DataFrame, claims: DataFrame, key: str, amount: str, count: str, most_claims: int = 4, most_exposure: float = 1.0, exposure: str = "Exposure") -> DataFrame:
    """Policies with their summed claim amount, counts and exposure capped: the usual frequency and severity table."""
    paid = claims.groupBy(key).agg(F.sum(amount).alias(amount))
    return policies.join(paid, key, "left").withColumns(
        {amount: F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), count: F.least(F.col(count), F.lit(most_claims)), exposure: F.least(F.col(exposure), F.lit(most_exposure))}
    )
