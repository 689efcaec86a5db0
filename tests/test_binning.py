import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from ashlar.operators import encode, grids
from ashlar.operators.grids import GridConfig


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(width=32), min_size=1, max_size=60), st.lists(st.floats(-100, 100, width=32), max_size=10, unique=True))
def test_bins_are_monotone_and_only_nan_is_missing(values, borders):
    borders = np.array(sorted(borders))
    x = np.sort(np.array(values, np.float32))
    found = grids.bins(x, borders)
    assert ((found == 0) == np.isnan(x)).all()
    data = found[~np.isnan(x)]
    assert (np.diff(data) >= 0).all() and (not len(data) or (data.min() >= 1 and data.max() <= len(borders) + 1))
    assert all(b == 1 + sum(c < v for c in borders) for b, v in zip(data, x[~np.isnan(x)], strict=True))


def test_midpoint_grid_and_permutation(spark):
    rows = [(float(v),) for v in [3, 1, 2, 2, float("nan"), float("inf"), 1]] + [(None,)]
    a = grids.build_grid(spark.createDataFrame(rows, "x double"), "x")
    b = grids.build_grid(spark.createDataFrame(rows[::-1], "x double").repartition(3), "x")
    assert a.tolist() == b.tolist() == [1.5, 2.5]
    assert grids.build_grid(spark.createDataFrame([(float("nan"),), (None,)], "x double"), "x").tolist() == []


@pytest.mark.parametrize("weighted", [False, True])
def test_quantile_grid_against_sorting(spark, weighted):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 10, 3000), 1).astype(np.float32).astype(float)
    w = rng.integers(1, 5, 3000).astype(float) if weighted else np.ones(3000)
    df = spark.createDataFrame(list(zip(x.tolist(), w.tolist(), strict=True)), "x double, w double")
    got = sorted(r["border"] for r in grids.quantile_borders(grids.distinct_values(df, "x", "w" if weighted else None), 16).collect())
    order = np.argsort(x, kind="stable")
    cum, xs = np.cumsum(w[order]), x[order]
    want = set()
    for k in range(1, 16):
        t = k * w.sum() / 16
        i = int(np.searchsorted(cum, t, "left"))
        want.add(float(np.float32((xs[i] + xs[min(i + 1, len(xs) - 1)]) / 2 if cum[i] == t else xs[i])))
    assert got == sorted(want)


def test_refill_and_collapse(spark):
    rows = [(1.0,)] * 500 + [(float(v),) for v in range(2, 300)]
    df = spark.createDataFrame(rows, "x double")
    full = grids.build_grid(df, "x", config=GridConfig(32))
    assert len(full) == 31 and (np.diff(full) > 0).all()
    few = grids.build_grid(df, "x", config=GridConfig(32, min_data_per_bin=100))
    counts = np.bincount(grids.bins(np.array([r[0] for r in rows]), few))
    assert len(few) < len(full) and counts[1:].min() >= 90
    with pytest.raises(ValueError):
        GridConfig(1)


def slow_refill(borders, values, target):
    """On all rows, one by one."""
    rows = sorted(values)
    cuts = sorted({0, len(rows), *[sum(v < b for v in rows) for b in borders]})
    parts, out = list(zip(cuts[:-1], cuts[1:])), list(borders)
    while len(out) < target:
        able = [(hi - lo, -lo, lo, hi) for lo, hi in parts if rows[lo] != rows[hi - 1]]
        if not able:
            break
        _, _, lo, hi = max(able)
        middle = min(max(lo + -(-(hi - lo) // 2), lo + 1), hi - 1)
        steps = [j for j in range(lo + 1, hi) if rows[j - 1] != rows[j]]
        cut = min(steps, key=lambda j: (abs(j - middle), j < middle))
        out.append(float(np.float32((rows[cut - 1] + rows[cut]) / 2)))
        parts[parts.index((lo, hi)) : parts.index((lo, hi)) + 1] = [(lo, cut), (cut, hi)]
    return sorted(set(out))


def test_refill_on_tied_columns(spark):
    """Nine tenths zeros: quantiles collapse, and the continuous rest gets the budget at its exact medians."""
    rng = np.random.default_rng(4)
    values = [0.0] * 9000 + [float(np.float32(v)) for v in rng.random(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    config = GridConfig(32)
    first = sorted(r["border"] for r in grids.quantile_borders(grids.distinct_values(df, "x"), 32).collect())
    got = grids.build_grid(df, "x", config=config).tolist()
    assert got == slow_refill(first, values, 31)
    assert len(got) == 31 and sum(b > 0.5 for b in got) > 8
    four = spark.createDataFrame([(float(v),) for v in range(4)], "x double")
    assert grids.refill(np.zeros(0), grids.distinct_values(four, "x"), 2).tolist() == [1.5]


def test_refill_takes_waves(spark, monkeypatch):
    """At 254 bins the heaviest intervals are found in fewer than ten rounds, and are those of cutting one by one."""
    rng = np.random.default_rng(7)
    values = [0.0] * 9000 + [float(np.float32(v)) for v in np.exp(rng.normal(size=2500))] + [2.0] * 300 + [5.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    waves = []
    real = grids.cut_intervals
    monkeypatch.setattr(grids, "cut_intervals", lambda running, asked: waves.append(len(asked)) or real(running, asked))
    first = sorted(r["border"] for r in grids.quantile_borders(grids.distinct_values(df, "x"), 254).collect())
    got = grids.build_grid(df, "x", config=GridConfig(254)).tolist()
    assert got == slow_refill(first, values, 253) and len(got) == 253
    assert len(waves) < 10 and sum(waves) < 3 * 253


def test_refill_with_weights(spark):
    """Rows of one value count alike, with their mean weight; zero weights make no cut of their own."""
    rng = np.random.default_rng(5)
    data = [(float(rng.integers(0, 40)), float(rng.integers(0, 4))) for _ in range(3000)] + [(50.0, 0.0), (60.0, 0.0)]
    df = spark.createDataFrame(data, "x double, w double")
    sums = {}
    for x, w in data:
        sums.setdefault(x, [0.0, 0])[0] += w
        sums[x][1] += 1
    xs = sorted(sums)
    rows = [(x, sums[x][0] / sums[x][1]) for x in xs for _ in range(sums[x][1])]
    prefix = np.concatenate(([0], np.cumsum([w for _, w in rows])))
    parts, out = [(0, len(rows))], []
    while len(out) < 9:
        able = [(round(prefix[hi] - prefix[lo], 9), -lo, lo, hi) for lo, hi in parts if rows[lo][0] != rows[hi - 1][0]]
        _, _, lo, hi = max(able)
        half = prefix[lo] + (prefix[hi] - prefix[lo]) / 2
        m = lo + 1
        while m + 1 < hi and prefix[m] < half - 1e-9:
            m += 1
        cut = min((j for j in range(lo + 1, hi) if rows[j - 1][0] != rows[j][0]), key=lambda j: (abs(j - m), j < m))
        out.append((rows[cut - 1][0] + rows[cut][0]) / 2)
        parts[parts.index((lo, hi)) : parts.index((lo, hi)) + 1] = [(lo, cut), (cut, hi)]
    assert grids.refill(np.zeros(0), grids.distinct_values(df, "x", "w"), 10).tolist() == sorted(out)


def test_null_keys_leave_other_hashes_alone(spark):
    from ashlar.functions import seed

    big = 2**60 + 12345
    df = spark.createDataFrame([(big,), (None,)], "k long").coalesce(1)
    got = {r.k: r.h for r in df.select("k", seed.row_hash(F.col("k"), 7, 0, 2).alias("h")).collect()}
    assert got == {big: seed.mix_seed(7, 0, 2, big) >> 1, None: None}


def _rows(spark):
    data = [(i, f"l{i % 7}" if i % 11 else None, float((i * 37) % 100)) for i in range(400)]
    df = spark.createDataFrame(data, "key long, level string, y double")
    return df, data


def test_kfold_does_not_read_its_own_fold(spark):
    df, data = _rows(spark)
    config = encode.EncodeConfig(least=0.0, smoothing=5.0)
    rows = encode.prepared(df, "level", "y", "key", config)
    base = encode.base_rate(rows)
    enc = {r["key"]: r["enc"] for r in encode.kfold_encodings(rows, 5.0, base, 5, 3).collect()}
    changed = spark.createDataFrame([(i, lv, y + 1000 if i == 17 else y) for i, lv, y in data], "key long, level string, y double")
    rows = encode.prepared(changed, "level", "y", "key", config)
    again = {r["key"]: r["enc"] for r in encode.kfold_encodings(rows, 5.0, base, 5, 3).collect()}
    assert enc[17] == again[17] and enc != again


def test_loo_and_ordered_exclude_the_row(spark):
    df, data = _rows(spark)
    rows = encode.prepared(df, "level", "y", "key", encode.EncodeConfig(least=0.0))
    base = encode.base_rate(rows)
    got = {r["key"]: r["enc"] for r in encode.loo_encodings(rows, 2.0, base).collect()}
    for i, lv, _ in data[:30]:
        others = [y for k, other, y in data if other == lv and k != i]
        assert abs(got[i] - (sum(others) + 2 * base) / (len(others) + 2)) < 1e-9
    ordered = encode.ordered_encodings(rows, 2.0, base, 1, 3)
    assert ordered.count() == 400 and ordered.where(f"abs(enc - {base}) < 1e-12").count() >= 7


def test_encoder_serves_rare_and_unseen(spark):
    data = [(i, ["a", "b", "rare1", "rare2"][min(i // 40, 3) if i < 84 else i % 2], float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(data, "key long, level string, y double")
    encoder, train = encode.fit_encoder(df, "level", "y", "key", encode.EncodeConfig(least=10.0))
    assert encoder.members == {"rare1": encode.RARE} or set(encoder.members) <= {"rare1", "rare2"}
    assert encoder.encode("never seen") == encoder.base and train.count() == 200
    served = {r["level"]: r["enc"] for r in encode.serve_encoded(df, "level", encoder).select("level", "enc").distinct().collect()}
    assert all(abs(v - encoder.encode(k)) < 1e-12 for k, v in served.items())


def test_null_level_is_a_level_of_its_own(spark):
    df, _ = _rows(spark)
    encoder, _ = encode.fit_encoder(df, "level", "y", "key", encode.EncodeConfig(least=0.0, smoothing=0.0))
    assert "None" in encoder.levels and encoder.encode(None) == encoder.levels["None"]
