import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.operators import explain, refit, ridge, score
from ashlar.operators.boost import BoostConfig, Booster
from ashlar.operators.model import Axis, InvalidParameter


def binned(spark, n=600):
    data = []
    for i in range(n):
        b0, b1 = i % 7 + 1, (i // 7) % 5
        data.append((i, b0, b1, 3.0 * (b0 > 4) + b1 + 2.0 * (b0 == 2 and b1 == 3), 1.0, 0.0))
    rows = spark.createDataFrame(data, "rid long, b0 short, b1 short, y double, w double, off double")
    return rows, [Axis(0, "x0", np.arange(6) + 0.5), Axis(1, "x1", np.arange(3) + 0.5)]


def error(rows, model):
    got = rows.select("rid", "b0", "b1", "y").collect()
    found = model.raw_score([np.array([r[c] for r in got]) for c in ("b0", "b1")])
    return float(np.mean((found - np.array([r["y"] for r in got])) ** 2))


def test_correction_helps_and_stays_exact(spark):
    rows, axes = binned(spark)
    model = Booster(axes, config=BoostConfig(n_trees=3, learning_rate=0.4)).fit(rows)
    better = refit.cell_correction(rows, model, base=1.0)
    assert better.corrections and error(rows, better) < 0.6 * error(rows, model)
    cells = score.cell_frame(rows, explain.merged_axes(better), ["rid"])
    assert max(explain.run_gates(better, explain.explain(better, cells)).values()) < 1e-8


def test_correction_does_no_harm(spark):
    rows, axes = binned(spark)
    noise = rows.withColumn("y", F.pmod(F.xxhash64("rid"), F.lit(1000)) / 1000.0)
    model = Booster(axes, config=BoostConfig(n_trees=1, learning_rate=0.1)).fit(noise)
    kept = refit.cell_correction(noise, model, base=1e6)
    assert error(noise, kept) <= error(noise, model) * 1.001


def test_selection_averages_library_members(spark):
    rows, axes = binned(spark)
    library = [BoostConfig(n_trees=0), BoostConfig(n_trees=4, learning_rate=0.6)]
    model = refit.select_ensemble(rows, axes, "squared_error", library, picks=4)
    assert error(rows, model) < 0.5 * error(rows, Booster(axes, config=library[0]).fit(rows))
    with pytest.raises(InvalidParameter):
        refit.select_ensemble(rows, axes, "squared_error", [])


def test_coarse_cells():
    assert refit.coarse_map(3, 24).tolist() == [0, 1, 2, 3]
    wide = refit.coarse_map(200, 24)
    assert wide[0] == 0 and wide.max() == 23 and (np.diff(wide) >= 0).all()


def test_many_cells_keep_their_pairs(spark, monkeypatch):
    """Steps by jobs give what the joint sums give, and no support is dropped."""
    rows, axes = binned(spark)
    model = Booster(axes, config=BoostConfig(n_trees=3, learning_rate=0.4)).fit(rows)
    joint = refit.cell_correction(rows, model, base=1.0, sweeps=3)
    monkeypatch.setattr(ridge, "JOINT_PAIRS", 1)
    steps = refit.cell_correction(rows, model, base=1.0, sweeps=3)
    assert [c.axes for c in steps.corrections] == [c.axes for c in joint.corrections] and any(len(c.axes) == 2 for c in steps.corrections)
    for a, b in zip(steps.corrections, joint.corrections, strict=True):
        assert np.allclose(a.values, b.values, atol=1e-9)
