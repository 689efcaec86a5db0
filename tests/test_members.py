"""Fits that grow together: bags, libraries, closed-form refinement, out-of-bag corrections, ridge systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.estimator import BoostedRegressor
from ashlar.functions import seed
from ashlar.functions.losses import SquaredError
from ashlar.operators import boost, refit, ridge
from ashlar.operators.boost import BoostConfig, Booster, kth_hashes
from ashlar.operators.model import Axis, InvalidParameter, Model, Split, Tree
from ashlar.operators.split import SplitConfig


def rows(spark, n=900, seed_=0, objective="squared_error"):
    rng = np.random.default_rng(seed_)
    b = rng.integers(0, 9, (n, 4))
    y = 2.0 * (b[:, 0] > 4) + b[:, 1] * 0.3 + 1.5 * ((b[:, 0] > 4) & (b[:, 2] <= 3)) + rng.normal(size=n) * 0.4
    if objective == "logistic":
        y = (y > np.median(y)).astype(float)
    elif objective != "squared_error":
        y = np.exp(np.clip(y / 3, -1, 2)) + (0 if objective == "poisson" else 0.1)
    data = [(i, *map(int, b[i]), float(y[i]), float(1 + i % 3), 0.1 * (i % 2)) for i in range(n)]
    df = spark.createDataFrame(data, "rid long, b0 smallint, b1 smallint, b2 smallint, b3 smallint, y double, w double, off double")
    return df.repartition(4), [Axis(a, f"x{a}", np.arange(7) + 0.5) for a in range(4)]


def same(a: Model, b: Model, tolerance: float = 0.0) -> bool:
    return abs(a.f0 - b.f0) <= tolerance and len(a.trees) == len(b.trees) and all(
        x == y and s.splits == t.splits and np.allclose(s.leaves, t.leaves, rtol=0, atol=tolerance) for (x, s), (y, t) in zip(a.trees, b.trees, strict=True)
    )


@pytest.mark.parametrize("objective", ["squared_error", "logistic", "gamma"])
def test_a_library_grows_as_its_members_alone(spark, objective, monkeypatch):
    df, axes = rows(spark, objective=objective)
    library = [
        BoostConfig(n_trees=3, learning_rate=0.5),
        BoostConfig(n_trees=5, learning_rate=0.2, max_order=2, split=SplitConfig(ridge=5.0), leaf_refine_steps=2),
        BoostConfig(n_trees=4, learning_rate=0.3, dart_rate=0.4, seed=3),
        BoostConfig(n_trees=4, learning_rate=0.3, subsample=0.5, colsample=0.5, seed=4, restage=2),
        BoostConfig(n_trees=9, learning_rate=0.9, validation_fraction=0.3, early_stopping=1, seed=5),
    ]
    together, _ = Booster(axes, objective, library[0]).fit_members(df, library)
    for config, model in zip(library, together, strict=True):
        alone = Booster(axes, objective, config).fit(df)
        # bounds of gradients are common to a library, so their rounding differs in the tenth digit
        assert same(alone, model, 1e-8)
    monkeypatch.setattr(boost, "HISTOGRAM_CELLS", 1)
    apart, _ = Booster(axes, objective, library[0]).fit_members(df, library)
    assert all(same(a, b) for a, b in zip(together, apart, strict=True))


def test_the_smaller_child_is_enough(spark, monkeypatch):
    """Histograms from subtraction lead to the trees that counting every child leads to."""
    df, axes = rows(spark)
    config = BoostConfig(n_trees=4, learning_rate=0.5, split=SplitConfig(min_rows=20))
    quick = Booster(axes, config=config).fit(df)
    real = Booster._histograms

    def whole(self, state, growths, unit):
        for g in growths:
            g.parents, counted = None, g.counted
            if counted is not None:
                g.counted = None
        leaves = [1 << len(g.splits) for g in growths]
        parts = [self._rows(g) for g in growths]
        wrapped = [lambda batch, f=f: (dict(enumerate((x := f(batch))[0])), *x[1:]) for f in parts]
        return boost.arrow_histograms(self._needed(state, [g.member for g in growths]), len(self.axes), leaves, self.bins, wrapped, unit)

    monkeypatch.setattr(Booster, "_histograms", whole)
    assert same(quick, Booster(axes, config=config).fit(df), 1e-12) and real is not whole
    assert max(len(t.splits) for _, t in quick.trees) == 3


def jobs_of(spark, run):
    sc = spark.sparkContext
    name = f"jobs-{np.random.default_rng().integers(1 << 60)}"
    sc.setJobGroup(name, "")
    run()
    sc.setJobGroup("", "")
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_squares_are_refined_without_further_jobs(spark):
    """The closed form takes the general loop's steps and needs no job beyond those of growing."""
    df, axes = rows(spark)
    plain, refined = (BoostConfig(n_trees=3, learning_rate=0.3, leaf_refine_steps=k, split=SplitConfig(monotone={1: 1})) for k in (0, 4))
    found = {}
    many = jobs_of(spark, lambda: found.update(closed=Booster(axes, config=refined).fit(df)))
    assert many == jobs_of(spark, lambda: Booster(axes, config=plain).fit(df))
    general = Booster(axes, config=refined)
    general.loss = SquaredError()
    object.__setattr__(general.loss, "name", "squares")
    # the general loop rounds gradients anew at each step
    assert same(found["closed"], general.fit(df), 1e-7)


def test_bags_take_no_more_jobs_than_one_fit(spark):
    df, axes = rows(spark)
    one = jobs_of(spark, lambda: Booster(axes, config=BoostConfig(n_trees=4)).fit(df))
    many = jobs_of(spark, lambda: Booster(axes, config=BoostConfig(n_trees=4, n_bags=6)).fit(df))
    # beyond it only the bags' bounds: a count, and at most five rounds of two jobs, whatever their number
    assert many <= one + 12


def test_hash_bounds(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("rid"))
    keys = np.arange(3000) * 7
    wanted = [(5, "bags", 1), (5, "bags", 3000), (9, "holdout", 700), (9, "bags", 1499)]
    for (base, stage, k), bound in zip(wanted, kth_hashes(df, wanted), strict=True):
        z = seed.mix_seed_array(base, 0, seed.STAGES[stage], keys) >> np.uint64(1)
        assert int((z <= np.uint64(bound)).sum()) == k


def test_coarse_histograms_find_the_splits(spark):
    """Gradients of ten bits find the same trees here, with leaves from whole gradients; of four bits still useful ones."""
    df, axes = rows(spark)
    fine, ten, four = (Booster(axes, config=BoostConfig(n_trees=3, learning_rate=0.4, hist_bits=k)).fit(df) for k in (30, 10, 4))
    assert same(fine, ten, 1e-9)
    data, bins = collected(df)
    error = lambda m: float((data["w"] * (m.raw_score(bins) + data["off"] - data["y"]) ** 2).sum())
    assert error(four) < 1.1 * error(fine)
    with pytest.raises(InvalidParameter):
        BoostConfig(hist_bits=3)


def test_bootstrap_bags(spark):
    """Rows drawn twice count twice: a bag is the fit of its repeated rows, and the rows left out are out of bag."""
    df, axes = rows(spark)
    config = BoostConfig(n_trees=3, learning_rate=0.4, n_bags=2, bootstrap=True, seed=6, split=SplitConfig(min_rows=15))
    models, members = Booster(axes, config=config).fit_members(df)
    for model, member in zip(models, members, strict=True):
        keys = np.arange(900)
        times = boost.drawn(keys, member.bound)
        assert 0.3 < (times == 0).mean() < 0.45 and 0.9 < times.mean() < 1.1
        repeated = df.join(spark.createDataFrame([(int(k), int(t)) for k, t in zip(keys, times)], "rid long, times int"), "rid").where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
        alone = Booster(axes, config=BoostConfig(n_trees=3, learning_rate=0.4, split=SplitConfig(min_rows=15))).fit(repeated.drop("times", "again"))
        assert same(model, alone, 1e-7)


def collected(df):
    table = df.orderBy("rid").toPandas()
    return {c: table[c].to_numpy() for c in table}, [table[f"b{i}"].to_numpy() for i in range(4)]


def test_out_of_bag_scores_and_correction(spark):
    """Against numpy: out-of-bag means, the ridge solution on the rows that learn, and the share that is kept."""
    df, axes = rows(spark)
    config = BoostConfig(n_trees=4, learning_rate=0.3, n_bags=3, bag_subsample=0.6, seed=11)
    booster = Booster(axes, config=config)
    models, members = booster.fit_members(df)
    averaged = booster.averaged(models)
    got = refit.cell_correction(df, averaged, base=20.0, gamma=1.0, held=refit.OUT_OF_BAG_HELD, base_seed=11, bags=(models, members))

    data, bins = collected(df)
    out = np.stack([~boost.in_bag(data["rid"], m.bound) for m in members])
    assert (out.sum(1) == len(data["rid"]) - np.ceil(0.6 * len(data["rid"]))).all()
    used = out.any(0)
    raw = (np.stack([m.raw_score(bins) for m in models]) * out).sum(0)[used] / out.sum(0)[used] + data["off"][used]
    assert np.allclose(refit.out_of_bag(models, members, data, bins)[0][used] + data["off"][used], raw)
    held = seed.mix_seed_array(11, 0, seed.STAGES["holdout"], data["rid"])[used] < np.uint64(int(refit.OUT_OF_BAG_HELD * 2**64))
    assert 0.08 < held.mean() < 0.22 and used.mean() < 1
    y, w = data["y"][used], data["w"][used]
    layout = refit._layout(averaged, refit.supports_of(averaged))
    at = [refit._column(maps, [bins[a][used] for a in u]) + first for u, maps, first, _ in layout]
    width = sum(size for *_, size in layout)
    design = np.zeros((used.sum(), width))
    for own in at:
        design[np.arange(len(own)), own] += 1
    learn = design[~held]
    gram, right = learn.T @ (learn * w[~held, None]), learn.T @ (w * (y - raw))[~held]
    flat = np.linalg.solve(gram + 20 * np.eye(width), right)
    strength = np.array([np.sqrt(np.mean(flat[f : f + s] ** 2)) for *_, f, s in layout])
    penalty = np.repeat(20 / np.maximum(strength / strength.mean(), 1e-3) ** 2, [s for *_, s in layout])
    delta = np.linalg.solve(gram + np.diag(penalty), right)
    deviances = [(w * (raw + s * (design @ delta) - y) ** 2)[held].sum() for s in refit.SHRINKS]
    share = refit.SHRINKS[int(np.argmin(deviances))]
    assert share > 0 and min(deviances) < deviances[0]
    for c, (u, maps, first, size) in zip(got.corrections, layout, strict=True):
        want = share * delta[first : first + size].reshape([m.max() + 1 for m in maps])[np.ix_(*maps)]
        assert c.axes == u and np.allclose(c.values, want, atol=2e-3)


def test_cell_refit_from_the_estimator(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (4000, 2))
    y = np.sin(x[:, 0]) * np.sign(x[:, 1] - 5) + rng.normal(size=4000) * 0.2
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(4000)], "id long, x0 double, x1 double, y double")
    fresh = rng.uniform(0, 10, (800, 2))
    truth = np.sin(fresh[:, 0]) * np.sign(fresh[:, 1] - 5)
    new = spark.createDataFrame([(i, *map(float, fresh[i]), float(truth[i])) for i in range(800)], "id long, x0 double, x1 double, y double")
    knobs = {"n_trees": 6, "learning_rate": 0.3, "n_bags": 3, "bag_subsample": 0.5, "max_bin": 12}
    errors = {}
    for name, more in (("plain", {}), ("corrected", {"cell_refit": refit.CellRefit(2.0, 1.0)})):
        model = BoostedRegressor("id", ["x0", "x1"], **knobs, **more).fit(df, "y")
        errors[name] = model.predict(new).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert errors["corrected"] < 0.8 * errors["plain"]
    with pytest.raises(InvalidParameter):
        BoostedRegressor("id", ["x0"], n_bags=1, cell_refit=refit.CellRefit())
    with pytest.raises(InvalidParameter):
        refit.CellRefit(base=0.0)


def test_selection_from_the_estimator(spark):
    df, _ = rows(spark)
    grid = refit.SettingsGrid(ridges=(0.0, 100.0), learning_rates=(0.02, 0.7), n_trees=(1, 6), max_orders=(3,))
    config = BoostConfig()
    assert [(c.split.ridge, c.learning_rate, c.n_trees) for c in (grid.at(k, config) for k in range(8))] == [
        (r, rate, n) for n in (1, 6) for rate in (0.02, 0.7) for r in (0.0, 100.0)
    ]
    frame = df.withColumnRenamed("rid", "id").select("id", *[F.col(f"b{i}").cast("double").alias(f"x{i}") for i in range(4)], "y")
    model = BoostedRegressor("id", [f"x{i}" for i in range(4)], selection=refit.Selection(8, grid, picks=5)).fit(frame, "y")
    error = lambda m: m.predict(frame).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    weak = BoostedRegressor("id", [f"x{i}" for i in range(4)], n_trees=1, learning_rate=0.02).fit(frame, "y")
    assert error(model) < 0.4 * error(weak)
    with pytest.raises(InvalidParameter):
        refit.SettingsGrid(ridges=())
    with pytest.raises(InvalidParameter):
        BoostedRegressor("id", ["x0"], n_bags=2, selection=refit.Selection()).fit(frame, "y")


@pytest.mark.parametrize("objective", ["squared_error", "logistic"])
def test_ridge_refit_against_dense_equations(spark, objective, monkeypatch):
    df, axes = rows(spark, objective=objective)
    plain = Booster(axes, objective, BoostConfig(n_trees=5, learning_rate=0.3)).fit(df)
    config = BoostConfig(n_trees=5, learning_rate=0.3, ridge_refit=True)
    found = Booster(axes, objective, config).fit(df)
    monkeypatch.setattr(ridge, "JOINT_PAIRS", 1)
    by_jobs = Booster(axes, objective, config).fit(df)
    assert same(found, by_jobs, 1e-7)
    data, bins = collected(df)
    loss = Booster(axes, objective).loss
    raw = plain.raw_score(bins) + data["off"]
    g, h = loss.numpy_gradient(data["y"], raw, data["w"])
    design = np.concatenate([alpha * np.eye(len(t.leaves))[t.leaf(bins)] for alpha, t in plain.trees], 1)
    leaves = np.concatenate([t.leaves for _, t in plain.trees])
    delta = np.linalg.solve(design.T @ (design * h[:, None]) + np.eye(len(leaves)), -design.T @ g - leaves)
    got = np.concatenate([t.leaves for _, t in found.trees])
    assert np.allclose(got, leaves + delta, atol=1e-6) or np.allclose(got, leaves + delta / 2, atol=1e-6)
    deviance = lambda m: loss.numpy_deviance(data["y"], m.raw_score(bins) + data["off"], data["w"]).sum()
    assert deviance(found) < deviance(plain)


def test_ridge_refit_of_a_thousand_trees(spark):
    """8000 leaves: no array of their square, one number per leaf from a task."""
    df, axes = rows(spark, 400)
    rng = np.random.default_rng(2)
    trees = [(1.0, Tree(tuple(Split(int(a), int(rng.integers(1, 8))) for a in rng.permutation(4)[:3]), tuple(rng.normal(size=8) / 300))) for _ in range(1000)]
    booster = Booster(axes, config=BoostConfig(ridge_refit=True, split=SplitConfig(ridge=50.0)))
    member = boost.Member(booster.config, "raw0", {"base": 0, "held": 0, "bag": None}, f0=1.0)
    refitted = booster._ridge(df, member, trees)
    data, bins = collected(df)
    score = lambda ts: 1.0 + data["off"] + sum(a * t.score(bins) for a, t in ts)
    before, after = (float((data["w"] * (score(ts) - data["y"]) ** 2).sum()) for ts in (trees, refitted))
    assert len(refitted) == 1000 and after < 0.5 * before


def test_many_axes_are_corrected_in_few_jobs(spark, monkeypatch):
    """Ten axes of 254 bins: their sums are gathered once, and all steps run on them."""
    rng = np.random.default_rng(3)
    b = rng.integers(1, 255, (500, 10))
    df = spark.createDataFrame([(i, *map(int, b[i]), float(b[i, 0] / 50), 1.0, 0.0) for i in range(500)], "rid long, " + ", ".join(f"b{k} smallint" for k in range(10)) + ", y double, w double, off double")
    axes = [Axis(k, f"x{k}", np.arange(253) + 0.5) for k in range(10)]
    model = Model(2.5, [(1.0, Tree((Split(k, 100),), (0.0, 0.0))) for k in range(10)], axes)
    systems = []
    real = ridge.RidgeSystem.__post_init__ if hasattr(ridge.RidgeSystem, "__post_init__") else None
    monkeypatch.setattr(ridge.RidgeSystem, "__post_init__", lambda self: systems.append(self), raising=False)
    out = refit.cell_correction(df, model, base=1.0)
    assert real is None and sum(s.jobs for s in systems) < 10 and out.corrections
