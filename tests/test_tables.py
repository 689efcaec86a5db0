"""Tables over their budgets, the raw gate, attributions of rows, and target statistics of a hot level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.estimator import BoostedRegressor
from ashlar.functions import seed
from ashlar.operators import encode, explain, score
from ashlar.operators.model import Axis, InvalidParameter, InvariantError, Model, SchemaMismatch, Split, Tree


def model_of(features, borders, trees, seed_=0):
    rng = np.random.default_rng(seed_)
    axes = [Axis(i, f"x{i}", np.arange(borders) + 0.5) for i in range(features)]
    made = [(float(rng.uniform(0.5, 1)), Tree(tuple(Split(int(a), int(rng.integers(1, borders + 1)), bool(rng.integers(2))) for a in rng.permutation(features)[:3]), tuple(rng.normal(size=8).tolist()))) for _ in range(trees)]
    return Model(0.3, made, axes)


def binned(spark, features, borders, n=400):
    b = np.random.default_rng(1).integers(0, borders + 2, (n, features))
    return spark.createDataFrame([(i, *map(int, b[i])) for i in range(n)], "id long, " + ", ".join(f"b{k} smallint" for k in range(features))), b


def trees_of(model, b):
    return model.raw_score([b[:, a] for a in range(b.shape[1])])


def test_a_table_over_two_million_cells_as_rows(spark):
    """133 cells an axis: the triple's 2.4 million cells are written by tasks, and joining them gives the trees' scores."""
    model = model_of(3, 131, 260)
    model.trees += [(0.1, Tree((Split(a, t),), (0.5, -0.5))) for a in range(3) for t in range(1, 132)]
    rows, b = binned(spark, 3, 131)
    cells = score.cell_frame(rows, explain.merged_axes(model), ["id"])
    bank = explain.explain(model, cells, overflow="sparse")
    assert np.prod([m.cells for m in bank.axes.values()]) > explain.TABLE_CELLS and set(bank.stored) == {(0, 1, 2)}
    stored = bank.stored[(0, 1, 2)]
    assert 2_000_000 < stored.count() <= np.prod([m.cells for m in bank.axes.values()]) and stored.rdd.getNumPartitions() > 1
    want = trees_of(model, b)
    for found in (score.joined_scores(cells, bank, "id"), score.table_scores(cells, bank, "id")):
        got = {r["id"]: r["raw_score"] for r in found.collect()}
        assert len(got) == len(b) and all(abs(got[i] - want[i]) < 1e-9 for i in range(len(b)))
    with pytest.raises(SchemaMismatch):
        score.joined_scores(cells, explain.explain(model, cells), "id")


def test_unknown_policies_are_refused():
    model = model_of(3, 3, 2)
    for bad in ("spares", "", "Factored"):
        with pytest.raises(InvalidParameter):
            explain.explain(model, overflow=bad)
    with pytest.raises(InvalidParameter):
        explain.explain(model, kind="uniform", overflow="sparse", table_cells=5)


def test_the_raw_gate_catches_a_planted_fault(spark, monkeypatch):
    """A wrong cell is found before purification, on joint cells and, where those are sampled, on the audit rows."""
    model = model_of(3, 4, 6)
    real = explain.accumulate

    def planted(*a, **k):
        tables, boxes = real(*a, **k)
        u = max(tables, key=len)
        tables[u] = tables[u].copy()
        tables[u][tuple(int(a[1][r].cell_of_bin(b[one : one + 1, a[1][r].axis])[0]) for r in u)] += 0.01
        return tables, boxes

    rows, b = binned(spark, 3, 4)
    one = int(np.flatnonzero((b > 0).all(1))[0])
    cells = score.cell_frame(rows, explain.merged_axes(model), ["id"])
    assert explain.raw_gate(model, explain.TableBank(model.f0, *[real(model, explain.merged_axes(model))[0], explain.merged_axes(model), explain.reference_weights(explain.merged_axes(model))]), cells) < 1e-9
    monkeypatch.setattr(explain, "accumulate", planted)
    monkeypatch.setattr(explain, "purify", lambda *a: pytest.fail("purified in spite of the fault"))
    with pytest.raises(InvariantError, match="accumulation"):
        explain.explain(model, cells)
    # joint cells that miss the fault: only the rows tell
    monkeypatch.setattr(explain, "_joint", lambda bank, rng_seed=0: ({r: np.zeros(1, int) for r in bank.axes}, np.ones(1)))
    with pytest.raises(InvariantError, match="accumulation"):
        explain.explain(model, cells)


def test_twelve_features_are_attributed_without_a_joint_grid(spark):
    model = model_of(12, 20, 120, 3)
    rows, b = binned(spark, 12, 20)
    cells = score.cell_frame(rows, explain.merged_axes(model), ["id"])
    bank = explain.explain(model, cells, table_cells=2000)
    assert len(bank.axes) == 12 and bank.boxes
    inter = bank.supports()[-1]
    got = {r["id"]: r for r in score.bank_scores(cells, bank, ["id"], shares=True, interactions=((1, 0), inter)).collect()}
    at = {r: m.cell_of_bin(b[:, m.axis]) for r, m in bank.axes.items()}
    shap, want = bank.shap(at), trees_of(model, b)
    for i in range(len(b)):
        assert abs(got[i]["raw_score"] - want[i]) < 1e-9 and abs(bank.f0 + sum(got[i][f"phi{r}"] for r in bank.axes) - want[i]) < 1e-9
        assert all(abs(got[i][f"phi{r}"] - shap[r][i]) < 1e-12 for r in bank.axes)
        assert abs(got[i]["inter_0_1"] - bank.faith_shap((0, 1), at)[i]) < 1e-12 and abs(got[i]["inter_" + "_".join(map(str, inter))] - bank.effect(inter, at)[i]) < 1e-12


def test_rows_are_explained_from_the_estimator(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, *map(float, x[i]), float(x[i, 0] * 2 + x[i, 1] * (x[i, 2] > 0))) for i in range(300)], "id long, a double, b double, c double, y double")
    model = BoostedRegressor("id", ["a", "b", "c"], n_trees=8, learning_rate=0.4, max_bin=16).fit(df, "y")
    bank = model.tables(df)
    scores = {r["id"]: r["raw_score"] for r in model.predict(df).collect()}
    for r in model.explain_rows(df, bank).collect():
        assert abs(r["raw_score"] - scores[r["id"]]) < 1e-9 and abs(bank.f0 + r["phi_a"] + r["phi_b"] + r["phi_c"] - r["raw_score"]) < 1e-9


def test_ordered_statistics_of_a_hot_level(spark):
    """A level with most of the rows is many groups, and each row is told from exactly those before it."""
    data = [(i, "hot" if i % 3 else f"l{i % 5}", float(i % 13), 1.0 + i % 2) for i in range(3000)]
    rows = spark.createDataFrame([(k, lv, y * d, d) for k, lv, y, d in data], "key long, label string, s double, d double").repartition(5)
    got = {r["key"]: r["enc"] for r in encode.ordered_encodings(rows, 2.0, 1.5, 2, 7).collect()}
    want = {k: 0.0 for k, *_ in data}
    for p in range(2):
        z = seed.mix_seed_array(7, p, seed.STAGES["folds"], np.arange(3000)) >> np.uint64(1)
        sums: dict = {}
        for k in sorted(range(3000), key=lambda k: (z[k], k)):
            _, lv, y, d = data[k]
            s, t = sums.get(lv, (0.0, 0.0))
            want[k] += (s + 2.0 * 1.5) / (t + 2.0) / 2 if t > 0 else 0.75
            sums[lv] = (s + y * d, t + d)
    assert len(got) == 3000 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = encode.ordered_encodings(rows, 2.0, 1.5, 1, 7)._jdf.queryExecution().sparkPlan().toString()
    groups = rows.withColumn("part", F.shiftright(seed.row_hash(F.col("key"), 7, 0, seed.STAGES["folds"]), 55)).where("label = 'hot'").select("part").distinct().count()
    assert "windowspecdefinition(label" in plan and "part0" in plan and groups > 200


def test_joined_scores_pass_the_rows_through_python_once(spark):
    """One Arrow pass and no shuffle however many tables, effects as local rows, and a score for each row of equal keys."""
    model = model_of(3, 20, 6)
    b = np.random.default_rng(5).integers(1, 22, (60, 3))
    rows = spark.range(60).select((F.col("id") % 40).alias("id"), *[F.element_at(F.array(*[F.lit(float(v) - 1) for v in b[:, k]]), (F.col("id") + 1).cast("int")).alias(f"x{k}") for k in range(3)])
    binned_rows = score.binned_frame(rows, model.axes, ["id"])
    cells = score.cell_frame(binned_rows, explain.merged_axes(model), ["id"])
    bank = explain.explain(model, cells)
    found = score.joined_scores(cells, bank, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(bank.supports()) > 3 and plan.count("MapInArrow") == 1
    assert "Exchange hashpartitioning" not in plan and "ExistingRDD" not in plan
    got, want = sorted((r["id"], r["raw_score"]) for r in found.collect()), sorted(zip([i % 40 for i in range(60)], trees_of(model, b), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want, strict=True))


def test_few_borders_are_binned_without_python_by_the_same_rule(spark):
    borders = np.array([-1.5, float(np.float32(0.1)), 0.5, 16777216.0])
    doubles = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -1.5, np.nextafter(-1.5, 0), 0.1, np.nextafter(0.1, 1), 0.5, 0.5000001, 16777216.0, 1e300, -1e300, 5e-324]
    df = spark.createDataFrame([(i, None if v is None else float(v), None if i == 3 else 16777214 + i, i % 2 == 0) for i, v in enumerate(doubles)], "id int, x double, n long, f boolean")
    axes = [Axis(0, "x", borders), Axis(1, "n", borders), Axis(2, "x", np.zeros(0))]
    own = score.binned_frame(df, axes, ["id"])
    assert "MapInArrow" not in own._jdf.queryExecution().executedPlan().toString()
    # a flag is not a number, so this frame takes the Arrow pass
    arrow = score.binned_frame(df, [*axes, Axis(3, "f", borders)], ["id"])
    assert "MapInArrow" in arrow._jdf.queryExecution().executedPlan().toString()
    assert own.dtypes == arrow.drop("b3").dtypes
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, arrow.drop("b3").collect()))


def test_the_raw_gate_sees_each_joint_cell_once(spark, monkeypatch):
    """Rows of equal cells go through Python as one, so its work does not grow with the rows."""
    model = model_of(3, 4, 6)
    rows, _ = binned(spark, 3, 4)
    cells = score.cell_frame(rows.crossJoin(spark.range(5).select(F.lit(1).alias("copy"))), explain.merged_axes(model), ["id"])
    kind, seen = type(cells), []
    real = kind.mapInArrow

    def counted(self, *a, **k):
        seen.append(self.count())
        return real(self, *a, **k)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    bank = explain.explain(model, cells)
    assert cells.count() == 2000 and len(seen) == 1 and seen[0] <= min(400, int(np.prod([m.cells for m in bank.axes.values()])))
