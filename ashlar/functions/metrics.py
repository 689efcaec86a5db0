"""Evaluation metrics as aggregates; those over an order use running sums by ranges, not one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_sums


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))).alias("rmse"))


def poisson_term(y: Column, p: Column) -> Column:
    return 2 * (F.when(y > 0, y * F.log(F.when(y > 0, y).otherwise(1.0) / p)).otherwise(F.lit(0.0)) - (y - p))


def gamma_term(y: Column, p: Column) -> Column:
    return 2 * (y / p - 1 - F.log(y / p))


def mean_deviance(df: DataFrame, y: str, p: str, w: str, kind: str) -> DataFrame:
    """Weighted mean Poisson or gamma deviance of predictions on the response scale."""
    term = {"poisson": poisson_term, "gamma": gamma_term}[kind](F.col(y), F.col(p))
    return df.agg((F.sum(F.col(w) * term) / F.sum(F.col(w))).alias("deviance"))


def d2(df: DataFrame, y: str, p: str, w: str, kind: str) -> DataFrame:
    """Share of the null model's deviance explained; the null model predicts the weighted mean."""
    mean = df.agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_m"))
    term = {"poisson": poisson_term, "gamma": gamma_term}[kind]
    both = df.crossJoin(F.broadcast(mean))  # one row
    return both.agg((1 - F.sum(F.col(w) * term(F.col(y), F.col(p))) / F.sum(F.col(w) * term(F.col(y), F.col("_m")))).alias("d2"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve, ties counted half. Equal scores are summed first."""
    by_score = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    ranked = running_sums(by_score, ["p"], {"upto": F.col("n") - F.col("pos")})
    below = F.col("upto") - (F.col("n") - F.col("pos")) / 2.0
    return ranked.agg((F.sum(F.col("pos") * below) / (F.sum("pos").cast("double") * F.sum(F.col("n") - F.col("pos")))).alias("auc"))


def lift_curve(df: DataFrame, y: str, p: str, w: str, key: str, buckets: int = 10) -> DataFrame:
    """``bucket, n, mean_y, mean_pred, lift``: equal-row buckets of falling prediction, ties by key."""
    n = df.count()
    weight = F.greatest(F.col(w), F.lit(0.0))
    ranked = running_sums(df.select(y, p, key, weight.alias("w")), [F.col(p).desc(), F.col(key)], {"i": F.lit(1)})
    # row i (from 0) lies in the largest bucket b with b * n div buckets <= i
    bucket = F.floor((F.col("i") * buckets - 1) / n) if n else F.lit(0)
    placed = ranked.withColumn("bucket", bucket.cast("long") + 1)
    sums = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col(y)).alias("sy"), F.sum(F.col("w") * F.col(p)).alias("sp"))
    overall = sums.agg((F.sum("sy") / F.sum("sw")).alias("m"))
    mean = F.when(F.col("sw") > 0, F.col("sy") / F.col("sw")).otherwise(0.0)
    return sums.crossJoin(F.broadcast(overall)).select(  # one row
        "bucket", "n", mean.alias("mean_y"), F.when(F.col("sw") > 0, F.col("sp") / F.col("sw")).otherwise(0.0).alias("mean_pred"), F.when(F.abs("m") > 2.3e-16, mean / F.col("m")).otherwise(0.0).alias("lift")
    )


def _concentration(df: DataFrame, y: str, order: str, w: str, key: str) -> DataFrame:
    weight = F.greatest(F.col(w), F.lit(0.0))
    own = df.select(F.col(order).alias("o"), F.col(key).alias("k"), weight.alias("w"), (weight * F.greatest(F.col(y), F.lit(0.0))).alias("wy"))
    run = running_sums(own, [F.col("o").desc(), F.col("k")], {"cy": F.col("wy")})
    return run.agg((F.sum(F.col("w") * (F.col("cy") - F.col("wy") / 2)) * 2 / (F.sum("w") * F.sum("wy")) - 1).alias("g"))


def ordered_gini(df: DataFrame, y: str, p: str, w: str, key: str) -> DataFrame:
    """Gini of the concentration curve by falling prediction over that by falling target."""
    model, perfect = _concentration(df, y, p, w, key), _concentration(df, y, y, w, key).withColumnRenamed("g", "best")
    return model.crossJoin(F.broadcast(perfect)).select(F.when(F.abs("best") > 2.3e-16, F.col("g") / F.col("best")).otherwise(0.0).alias("gini"))  # one row each
