"""Scoring on streams: a fitted model is one stateless projection, so it runs unchanged on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import Model
from ..operators.score import predict


def score_stream(stream: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The stream's rows with raw score and prediction; appends only, no state."""
    return predict(stream, model, keep)


def windowed_calibration(scored: DataFrame, time: str, y: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per tumbling window the rows, mean prediction and mean target; rows later than the watermark are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_pred"), F.avg(y).alias("mean_y"))
