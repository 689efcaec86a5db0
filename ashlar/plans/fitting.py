"""Queries of losses, histograms, splits, leaves, samples, scores, tables, metrics and whole fits, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, seed
from ..functions.losses import Gamma, Logistic, Poisson, SquaredError, Tweedie
from ..operators import explain, histogram, refit, sampling, score, split
from ..estimator import BoostedRegressor
from ..operators.boost import BoostConfig, Booster, Member
from ..operators.model import Axis, Correction, Model, Split, Tree
from ..session import spread, staged, table
from ..sources.frames import claims_frame
from .binning import BINNED_SQL, BORDERS, binned, floats, rounded

LOSSES = {
    # name: loss, target, its SQL, raw score and its SQL, weight
    "squared_error": (SquaredError(), lambda: F.col("y"), "y", lambda: F.lit(10.5), "10.5e0"),
    "logistic": (Logistic(), lambda: ((F.col("l_quantity") <= 20) != (F.col("l_discount") <= 0.03)).cast("double"), "((l_quantity <= 20) <> (l_discount <= 0.03))::int::double", lambda: F.col("l_tax") * 20 - 0.8, "l_tax * 20 - 0.8e0"),
    "poisson": (Poisson(), lambda: F.floor("l_quantity").cast("double") % 5, "floor(l_quantity) % 5", lambda: F.col("l_tax") * 10, "l_tax * 10"),
    "gamma": (Gamma(), lambda: F.col("l_extendedprice") / 1000, "l_extendedprice / 1000", lambda: F.col("l_quantity") / 20 + 1.0, "l_quantity / 20 + 1.0e0"),
    "tweedie": (Tweedie(1.5), lambda: F.greatest(F.col("l_quantity") - 25, F.lit(0.0)), "greatest(l_quantity - 25, 0e0)", lambda: F.col("l_quantity") / 25, "l_quantity / 25"),
}

_SIGMOID = "(case when f >= 0 then 1 / (1 + exp(-f)) else exp(f) / (1 + exp(f)) end)"
_MU = "exp(greatest(least(f, 30e0), -30e0))"
GRADIENT_SQL = {
    "squared_error": ("w * (f - y)", "w"),
    "logistic": (f"w * ({_SIGMOID} - y)", f"w * {_SIGMOID} * (1 - {_SIGMOID})"),
    "poisson": (f"w * ({_MU} - y)", f"w * {_MU}"),
    "gamma": ("w * (1 - y * exp(-f))", "w * y * exp(-f)"),
    "tweedie": ("w * (exp(0.5e0 * f) - y * exp(-0.5e0 * f))", "w * (0.5e0 * exp(0.5e0 * f) + 0.5e0 * y * exp(-0.5e0 * f))"),
}
DEVIANCE_SQL = {
    "squared_error": "0.5e0 * w * (f - y) * (f - y)",
    "logistic": f"2 * w * (case when y > 0 then y * ln(y / {_SIGMOID}) else 0e0 end + case when y < 1 then (1 - y) * ln((1 - y) / (1 - {_SIGMOID})) else 0e0 end)",
    "poisson": f"2 * w * (case when y > 0 then y * ln(y / {_MU}) else 0e0 end - (y - {_MU}))",
    "gamma": f"2 * w * (y / {_MU} - 1 - ln(y / {_MU}))",
    "tweedie": f"2 * w * (sqrt(y) / -0.25e0 - y * {_MU} ** -0.5e0 / -0.5e0 + {_MU} ** 0.5e0 / 0.5e0)",
}


def _lossy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, y, _, f, _ = LOSSES[name]
    return binned(spark, sf_dir).select("l_orderkey", "l_linenumber", y().alias("y"), f().alias("f"), (1 + F.col("l_tax")).alias("w"), F.log(F.col("l_quantity")).alias("off"))


def _lossy_sql(name: str) -> str:
    _, _, y, _, f = LOSSES[name]
    return f"(select l_orderkey, l_linenumber, {y} y, {f} f, 1 + l_tax w, ln(l_quantity) off from ({BINNED_SQL}))"


def grad_hess(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, h = LOSSES[name][0].gradient(F.col("y"), F.col("f"), F.col("w"))
        return _lossy(spark, sf_dir, name).select("l_orderkey", "l_linenumber", rounded(g).alias("g"), rounded(h).alias("h"))

    return run


def deviance(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = LOSSES[name][0].deviance_terms(F.col("y"), F.col("f"), F.col("w"))
        return _lossy(spark, sf_dir, name).agg(rounded(F.sum(d), 3).alias("deviance"))

    return run


def init_score(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _lossy(spark, sf_dir, name)
        if name == "poisson":
            value = LOSSES[name][0].start_score(rows)
        else:
            value = LOSSES[name][0].start_score(rows.withColumn("off", F.lit(0.0)))
        return spark.createDataFrame([(round(value, 6),)], "f0 double")

    return run


INIT_SQL = {
    "squared_error": "select round(sum(w * y) / sum(w), 6) f0 from",
    "logistic": "select round(ln(p / (1 - p)), 6) f0 from (select sum(w * y) / sum(w) p from",
    "poisson": "select round(ln(sum(w * y) / sum(w * exp(off))), 6) f0 from",
    "gamma": "select round(ln(sum(w * y) / sum(w)), 6) f0 from",
    "tweedie": "select round(ln(sum(w * y) / sum(w)), 6) f0 from",
}

GH = ["g", "h"]
_HIST_ROWS = f"(select *, 10.5e0 - y g, 1.0e0 h, l_quantity wt from ({BINNED_SQL}))"


def _hist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).withColumns({"g": 10.5 - F.col("y"), "h": F.lit(1.0)})


def _shown(hist: DataFrame, digits: int = 5) -> DataFrame:
    keys = [c for c in ("leaf", "axis", "bin") if c in hist.columns]
    return hist.select(*[F.col(k).cast("long").alias(k) for k in keys], *[rounded(F.col(c).cast("double"), digits).alias(c) for c in ("g", "h", "w")], "n")


def _hist_sql(weight: str = "1.0e0", leaf: str = "0", where: str = "true") -> str:
    parts = [f"select {leaf} leaf, {a} axis, b{a} bin, sum(g) g, sum(h) h, sum({weight}) w, count(*) n from {_HIST_ROWS} where {where} group by 1, 2, 3" for a in range(3)]
    return " union all ".join(parts)


_SHOW = "leaf::bigint leaf, axis::bigint axis, bin::bigint bin, round(g, 5) + 0e0 g, round(h, 5) + 0e0 h, round(w, 5) + 0e0 w, n"


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(histogram.histogram(_hist_rows(spark, sf_dir), ["b0", "b1", "b2"]))


def hist_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(histogram.histogram(_hist_rows(spark, sf_dir), ["b0", "b1", "b2"], w="l_quantity"))


def hist_two_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.when(F.col("b0") <= 2, 1).otherwise(0)
    return _shown(histogram.histogram(_hist_rows(spark, sf_dir), ["b0", "b1", "b2"], leaf=leaf))


def hist_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(histogram.quantized_histogram(_hist_rows(spark, sf_dir), ["b0", "b1", "b2"]), 3)


def hist_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's Arrow histogram, as rows."""

    def state(batch):
        n = len(batch["g"])
        return [batch[f"b{i}"] for i in range(3)], np.zeros(n, np.int64), batch["g"], batch["h"], np.ones(n)

    found = histogram.arrow_histogram(_hist_rows(spark, sf_dir).select("b0", "b1", "b2", "g", "h"), 3, 1, 7, state)
    rows = [(int(leaf), int(a), int(b), *[round(float(x), 5) + 0.0 for x in found[leaf, a, b, :3]], int(found[leaf, a, b, 3])) for leaf, a, b in np.argwhere(found[..., 3] > 0)]
    return spark.createDataFrame(rows, "leaf long, axis long, bin long, g double, h double, w double, n long")


def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hist_rows(spark, sf_dir)
    parent = histogram.histogram(rows, ["b0", "b1", "b2"])
    child = histogram.histogram(rows.where("b0 <= 2"), ["b0", "b1", "b2"])
    return _shown(histogram.subtract(parent, child).where("n > 0"))


DATA_BINS = {i: len(b) + 1 for i, b in enumerate(BORDERS.values())}


def _scan(spark: SparkSession, sf_dir: str, config: split.SplitConfig, leaf=None, missing: bool = False) -> DataFrame:
    rows = _hist_rows(spark, sf_dir)
    if missing:
        rows = rows.withColumn("b0", F.when(F.col("l_linenumber") == 3, F.lit(0)).otherwise(F.col("b0")).cast("smallint"))
    return split.gain_scan(histogram.histogram(rows, ["b0", "b1", "b2"], leaf=leaf and leaf()), DATA_BINS, config)


def _scan_shown(scan: DataFrame) -> DataFrame:
    return scan.select(F.col("axis").cast("long").alias("axis"), F.col("bin_le").cast("long").alias("bin_le"), "missing_left", rounded(F.col("gain"), 4).alias("gain"), "ok")


def gain_scan(config: split.SplitConfig, leaf=None, missing: bool = False):
    return lambda spark, sf_dir: _scan_shown(_scan(spark, sf_dir, config, leaf, missing))


def best_split(config: split.SplitConfig, leaf=None, missing: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = split.best_split(_scan(spark, sf_dir, config, leaf, missing), config)
        return best.select(F.col("axis").cast("long").alias("axis"), F.col("bin_le").cast("long").alias("bin_le"), "missing_left", rounded(F.col("gain"), 4).alias("gain"))

    return run


def found_split(config: split.SplitConfig):
    """The split that a tree in work takes at its root, from its own histogram and search."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def state(batch):
            n = len(batch["g"])
            return [batch[f"b{i}"] for i in range(3)], np.zeros(n, np.int64), batch["g"], batch["h"], np.ones(n)

        hist = histogram.arrow_histogram(_hist_rows(spark, sf_dir).select("b0", "b1", "b2", "g", "h"), 3, 1, 7, state)
        best, gain, _ = split.find_split(hist, demo_model().axes, [], config, [0, 1, 2], 7, 3)
        return spark.createDataFrame([(best.axis, best.bin_le, best.missing_left, round(gain, 4))], "axis long, bin_le long, missing_left boolean, gain double")

    return run


def found_sql(score: str, rising: int | None = None) -> str:
    """The candidate of the best score; a feature ``rising`` may only be cut where its high side has the larger value."""
    return f"with {scan_sql(rising=rising)} select axis, bin_le, missing_left, round(gain_, 4) + 0e0 gain from scan where ok and gain_ > 0 order by {score} desc, axis, bin_le, missing_left limit 1"


def scan_sql(leaf: str = "0", missing: bool = False, l1: float = 0.0, clamp: float = 0.0, rows: int = 0, rising: int | None = None) -> str:
    def term(g: str, h: str) -> str:
        s = g if not l1 else f"(case when {g} > {l1} then {g} - {l1} when {g} < -{l1} then {g} + {l1} else 0e0 end)"
        w = f"(-({s}) / ({h} + 1))"
        if clamp:
            w = f"greatest(least({w}, {clamp}e0), -{clamp}e0)"
        return f"greatest(-2 * ({s}) * {w} - ({h} + 1) * {w} * {w}, 0e0)"

    b0 = "case when l_linenumber = 3 then 0 else b0 end" if missing else "b0"
    grid = " union all ".join(f"select {a} axis, {nb} nb, unnest(range(0, {nb} + 1)) bin" for a, nb in DATA_BINS.items())
    long = " union all ".join(f"select {leaf} leaf, {a} axis, {b0 if a == 0 else f'b{a}'} bin, g, h from {_HIST_ROWS}" for a in DATA_BINS)
    return f"""h0 as (select leaf, axis, bin, sum(g) g, sum(h) h, count(*) n from ({long}) group by 1, 2, 3),
      c as (select leaf, axis, nb, bin, coalesce(g, 0e0) g, coalesce(h, 0e0) h, coalesce(n, 0) n from (select * from (select distinct leaf from h0), ({grid})) left join h0 using (leaf, axis, bin)),
      p as (select *, sum(g) over w tg, sum(h) over w th, sum(n) over w tn, sum(case when bin = 0 then g else 0e0 end) over w mg, sum(case when bin = 0 then h else 0e0 end) over w mh, sum(case when bin = 0 then n else 0 end) over w mn,
        sum(g) over o cg, sum(h) over o ch, sum(n) over o cn from c window w as (partition by leaf, axis), o as (partition by leaf, axis order by bin)),
      s as (select axis, bin bin_le, missing_left, tg, th, tn, cg - mg + case when missing_left then mg else 0e0 end lg, ch - mh + case when missing_left then mh else 0e0 end lh, cn - mn + case when missing_left then mn else 0 end ln_
        from p, (values (false), (true)) m(missing_left) where bin >= 1 and bin < nb),
      scan as (select axis::bigint axis, bin_le::bigint bin_le, missing_left, sum(({term('lg', 'lh')} + {term('(tg - lg)', '(th - lh)')} - {term('tg', 'th')}) / 2) gain_, bool_and(ln_ >= {rows} and tn - ln_ >= {rows}{'' if rising is None else f' and (axis <> {rising} or lg / (lh + 1) - (tg - lg) / (th - lh + 1) >= -1e-12)'}) ok from s group by 1, 2, 3)"""


def scan_shown_sql(**k) -> str:
    return f"with {scan_sql(**k)} select axis, bin_le, missing_left, round(gain_, 4) + 0e0 gain, ok from scan"


def best_sql(**k) -> str:
    return f"with {scan_sql(**k)} select axis, bin_le, missing_left, round(gain_, 4) + 0e0 gain from scan where ok and gain_ > 0 order by round(gain_, 9) desc, axis, bin_le, missing_left limit 1"


def _two_leaves():
    return F.when(F.col("b0") <= 2, 1).otherwise(0)


_LEAF_SQL = "case when b0 <= 2 then 1 else 0 end"

TREES = [
    (1.0, Tree((Split(0, 2), Split(1, 1), Split(2, 1, True)), (0.1, -0.2, 0.3, 0.4, -0.5, 0.6, 0.7, -0.8))),
    (0.5, Tree((Split(1, 2), Split(0, 3)), (1.0, -1.0, 0.5, 0.25))),
    (1.0, Tree((Split(2, 2),), (0.125, -0.375))),
]


def demo_model() -> Model:
    """Three fixed trees over the demonstration grids."""
    axes = [Axis(i, n, np.array(floats(b))) for i, (n, b) in enumerate(BORDERS.items())]
    return Model(0.25, TREES, axes)


def _tree_sql(alpha: float, tree: Tree, b: str = "b") -> str:
    bits = " + ".join(f"{1 << k} * (case when {b}{s.axis} = 0 then {int(s.missing_left)} when {b}{s.axis} <= {s.bin_le} then 1 else 0 end)" for k, s in enumerate(tree.splits))
    return f"{alpha}e0 * ([{', '.join(f'{v}e0' for v in tree.leaves)}])[({bits}) + 1]"


SCORE_SQL = " + ".join(["0.25e0", *[_tree_sql(a, t) for a, t in TREES]])


def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.predict(table(spark, sf_dir, "lineitem"), demo_model(), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("raw_score")).alias("raw_score"))


def correction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = demo_model()
    model.trees = []
    model.corrections = [Correction((0, 1), np.arange(24.0).reshape(6, 4) / 8)]
    out = score.predict(table(spark, sf_dir, "lineitem"), model, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("raw_score")).alias("raw_score"))


def dart_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after a round that dropped the first tree: it and the new one are renormalised as dropout does."""
    model = demo_model()
    member = Member(BoostConfig(), "raw0", {}, trees=[(1.0, TREES[0][1]), TREES[1]])
    member.take(TREES[2][1], [0])
    model.trees = member.trees
    out = score.predict(table(spark, sf_dir, "lineitem"), model, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("raw_score")).alias("raw_score"))


def leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves' values from their sums, as a tree in work gets them."""
    splits = [Split(s.axis, s.bin_le) for s in TREES[0][1].splits]

    def state(batch):
        n = len(batch["g"])
        leaf = sum(s.low(batch[f"b{s.axis}"]).astype(np.int64) << k for k, s in enumerate(splits))
        return [np.zeros(n, np.int64)], leaf, batch["g"], batch["h"], np.ones(n)

    sums = histogram.arrow_histogram(_hist_rows(spark, sf_dir).select("b0", "b1", "b2", "g", "h"), 1, 8, 1, state)[:, 0, 0]
    values = split.leaf_values(sums, split.SplitConfig(), splits, 0.3)
    return spark.createDataFrame([(k, round(float(v), 6) + 0.0) for k, v in enumerate(values) if sums[k, 3]], "leaf long, value double")


def leaf_path_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = split.SplitConfig(path_smooth=50.0)
    splits = [Split(0, 2), Split(1, 1)]

    def state(batch):
        n = len(batch["g"])
        leaf = splits[0].low(batch["b0"]).astype(np.int64) | splits[1].low(batch["b1"]).astype(np.int64) << 1
        return [np.zeros(n, np.int64)], leaf, batch["g"], batch["h"], np.ones(n)

    last = histogram.arrow_histogram(_hist_rows(spark, sf_dir).select("b0", "b1", "g", "h"), 1, 4, 1, state)[:, 0, 0]
    middle = last[:2] + last[2:]
    values = split.leaf_values(last, config, splits, 1.0, [middle.sum(0, keepdims=True), middle, last])
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "leaf long, value double")


_SMOOTH_SQL = f"""with r as (select g, h, (case when b0 <= 2 then 1 else 0 end) a, (case when b1 <= 1 then 1 else 0 end) b from {_HIST_ROWS}),
 p as (select a, -sum(g) / (sum(h) + 1) * count(*) / (count(*) + 50) pv from r group by 1),
 l as (select a, b, -sum(g) / (sum(h) + 1) v, count(*) n from r group by 1, 2)
 select (a + 2 * b)::bigint leaf, round((v * n + pv * 50) / (n + 50), 6) value from l join p using (a)"""


def mvs_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumns({"g": F.col("o_totalprice") / 1000 - 150, "h": F.lit(1.0)})
    return sampling.mvs_sample(rows, "o_orderkey", F.col("g"), F.col("h"), 0.1, 7).select("o_orderkey")


def validation_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.carve(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 7)[1].select("o_orderkey")


def subagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.subsample(table(spark, sf_dir, "orders"), "o_orderkey", 0.5, 7, 3).select("o_orderkey")


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bootstrap_weights(table(spark, sf_dir, "orders"), "o_orderkey", 7, 0, "times").select("o_orderkey", F.col("times").cast("long").alias("times"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the part it falls into."""
    train, test = sampling.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 4, 7)
    return train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))


def claims_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as policies and their lines as claims: summed amounts, capped counts and exposures."""
    policies = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("claims"), (F.col("o_totalprice") / 300_000).alias("years"))
    claims = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"))
    out = claims_frame(policies, claims, "o_orderkey", "amount", "claims", exposure="years")
    return out.select("o_orderkey", rounded(F.col("amount"), 2).alias("amount"), F.col("claims").cast("long").alias("claims"), rounded(F.col("years"), 9).alias("years"))


def column_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in sampling.sampled_columns(20, 0.3, 7, 2)], "axis long")


def reanchor(link: str):
    """The shift that the booster adds to the intercept after a fit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = demo_model()
        keyed = table(spark, sf_dir, "lineitem").withColumns({"rid": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "y": F.col("l_quantity"), "w": F.lit(1.0), "off": F.lit(0.0)})
        booster = Booster(model.axes, {"identity": "squared_error", "log": "poisson"}[link])
        member = Member(booster.config, "raw0", {"base": 0, "held": 0, "bag": None}, f0=model.f0)
        shift = booster.anchor(score.binned_frame(keyed, model.axes, ["rid", "y", "w", "off"]), member, model.trees)
        return spark.createDataFrame([(round(float(shift), 6) + 0.0,)], "shift double")

    return run


def _bank(spark: SparkSession, sf_dir: str, kind: str = "product") -> tuple[DataFrame, explain.TableBank]:
    model = demo_model()
    bins = score.binned_frame(table(spark, sf_dir, "lineitem"), model.axes, ["l_orderkey", "l_linenumber"])
    cells = score.cell_frame(bins, explain.merged_axes(model), ["l_orderkey", "l_linenumber"])
    return cells, explain.explain(model, cells, kind)


def ref_weights(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, bank = _bank(spark, sf_dir, kind)
        return spark.createDataFrame([(r, c, round(float(x), 9)) for r, w in bank.weights.items() for c, x in enumerate(w)], "raw long, cell long, w double")

    return run


CUTS = {m.raw: m.cuts for m in explain.merged_axes(demo_model()).values()}


def cell_sql(raw: int) -> str:
    whens = " ".join(f"when b{raw} <= {t} then {k + 1}" for k, t in enumerate(CUTS[raw]))
    return f"(case when b{raw} = 0 then 0 {whens} else {len(CUTS[raw]) + 1} end)"


_N = {r: len(c) + 2 for r, c in CUTS.items()}
WEIGHTS_SQL = " union all ".join(
    f"select {r} raw, cell, (1e0 / {n} + coalesce(k, 0) / (select count(*)::double from lineitem)) / 2 w from (select unnest(range(0, {n})) cell) left join (select {cell_sql(r)} cell, count(*) k from ({BINNED_SQL}) group by 1) using (cell)"
    for r, n in _N.items()
)


def support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _bank(spark, sf_dir, "uniform")
    return explain.cell_counts(cells, ["c0", "c1"]).select(F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"), "n")


def purified(order: int, kind: str = "product"):
    """The pure tables of one order, cell by cell, and for order 1 the constant as well."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, bank = _bank(spark, sf_dir, kind)
        rows = [("".join(map(str, u)), *[*map(int, at), -1, -1][:3], round(float(v), 9) + 0.0) for u, t in bank.tables.items() if len(u) == order for at, v in np.ndenumerate(t)]
        if order == 1:
            rows.append(("f0", -1, -1, -1, round(bank.f0, 9)))
        return spark.createDataFrame(rows, "features string, cell0 long, cell1 long, cell2 long, value double")

    return run


def purify_sql() -> str:
    """The function on the full joint grid, and its projections by inclusion and exclusion."""
    trees = " + ".join(["0.25e0", *[_tree_sql(a, t, "r") for a, t in TREES]])
    reps = {r: [0, *c, c[-1] + 1] for r, c in CUTS.items()}
    grid = ", ".join(f"(select cell c{r}, w w{r}, ({reps[r]})[cell + 1] r{r} from wts where raw = {r}) t{r}" for r in CUTS)
    mean = {u: f"sum(f * w0 * w1 * w2) over (partition by {', '.join(f'c{r}' for r in u)}) / ({' * '.join(f'w{r}' for r in u)})" for u in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2))}
    cols = ", ".join(f"{v} m{''.join(map(str, u))}" for u, v in mean.items())
    return f"""wts as ({WEIGHTS_SQL}), joint as (select *, {trees} f from {grid}),
      j as (select *, sum(f * w0 * w1 * w2) over () m, {cols} from joint),
      e as (select *, m0 - m e0, m1 - m e1, m2 - m e2, m01 - m0 - m1 + m e01, m02 - m0 - m2 + m e02, m12 - m1 - m2 + m e12,
        f - m01 - m02 - m12 + m0 + m1 + m2 - m e012 from j)"""


def _effect_sql(u: tuple[int, ...]) -> str:
    name, cells = "".join(map(str, u)), [f"c{r}" for r in u]
    shown = ", ".join(f"{c}::bigint cell{k}" for k, c in enumerate(cells + ["-1"] * (3 - len(cells))))
    return f"select distinct '{name}' features, {shown}, round(e{name}, 9) + 0e0 \"value\" from e"


_SUPPORTS = [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def table_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bank = _bank(spark, sf_dir)
    total = sum(bank.variance(u) for u in bank.supports())
    return spark.createDataFrame([("".join(map(str, u)), round(bank.variance(u), 9) + 0.0, round(bank.variance(u) / total, 9) + 0.0) for u in bank.supports()], "features string, variance double, sobol double")


_VARIANCE_SQL = "with " + purify_sql() + ", v as (" + " union all ".join(f"select '{''.join(map(str, u))}' features, sum(w0 * w1 * w2 * e{''.join(map(str, u))} ** 2) variance from e" for u in _SUPPORTS) + ") select features, round(variance, 9) + 0e0 variance, round(variance / sum(variance) over (), 9) + 0e0 sobol from v"


def shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every row, from its own cells."""
    cells, bank = _bank(spark, sf_dir)
    out = score.attributions(cells, bank, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[rounded(F.col(f"phi{r}")).alias(f"phi{r}") for r in range(3)])


_SHAP_SQL = f"""with {purify_sql()}, b as (select l_orderkey, l_linenumber, {cell_sql(0)} c0, {cell_sql(1)} c1, {cell_sql(2)} c2 from ({BINNED_SQL}))
 select l_orderkey, l_linenumber, round(e0 + (e01 + e02) / 2 + e012 / 3, 6) + 0e0 phi0, round(e1 + (e01 + e12) / 2 + e012 / 3, 6) + 0e0 phi1, round(e2 + (e02 + e12) / 2 + e012 / 3, 6) + 0e0 phi2
 from b join e using (c0, c1, c2)"""


def faith_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bank = _bank(spark, sf_dir)
    grid = np.indices([bank.axes[r].cells for r in (0, 1)]).reshape(2, -1)
    value = bank.faith_shap((1, 0), {0: grid[0], 1: grid[1], 2: np.zeros(grid.shape[1], int)})
    return spark.createDataFrame([(int(a), int(b), round(float(v), 9) + 0.0) for a, b, v in zip(*grid, value, strict=True)], "c0 long, c1 long, value double")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether each gate holds."""
    _, bank = _bank(spark, sf_dir)
    found = explain.run_gates(demo_model(), bank)
    return spark.createDataFrame([tuple(bool(found[g] < 1e-6) for g in ("reconstruction", "mass", "purity", "variance", "three_way"))], "reconstruction boolean, mass boolean, purity boolean, variance boolean, three_way boolean")


def rating_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by table lookups; they have to be the trees' scores."""
    cells, bank = _bank(spark, sf_dir)
    keyed = cells.withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return score.table_scores(keyed, bank, "k").select("k.l_orderkey", "k.l_linenumber", rounded(F.col("raw_score")).alias("raw_score"))


def rating_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by joining effects, over orders whose key is unique."""
    model = demo_model()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("l_quantity"), (F.col("o_orderkey") % 11 / 100).alias("l_discount"), (F.col("o_orderkey") % 9 / 100).alias("l_tax"))
    cells = score.cell_frame(score.binned_frame(orders, model.axes, ["o_orderkey"]), explain.merged_axes(model), ["o_orderkey"])
    out = score.joined_scores(cells, explain.explain(model, cells), "o_orderkey")
    return out.select("o_orderkey", rounded(F.col("raw_score")).alias("raw_score"))


_JOIN_SQL = f"select o_orderkey, round({SCORE_SQL}, 6) + 0e0 raw_score from (select o_orderkey, " + ", ".join(
    f"(case {' '.join(f'when ({x})::float::double <= {b!r}e0::float::double then {k + 1}' for k, b in enumerate(borders))} else {len(borders) + 1} end) b{i}"
    for i, (x, borders) in enumerate(zip(("o_custkey % 50", "o_orderkey % 11 / 100", "o_orderkey % 9 / 100"), BORDERS.values(), strict=True))
) + " from orders)"


def rating_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.export import rebased

    _, bank = _bank(spark, sf_dir)
    f0, tables = rebased(bank, {0: 1, 1: 1})
    rows = [("f0", -1, round(f0, 7))] + [(str(r), c, round(float(v), 7) + 0.0) for r in (0, 1) for c, v in enumerate(tables[(r,)])]
    return spark.createDataFrame(rows, "features string, cell long, value double")


_REBASE_SQL = f"""with {purify_sql()}, r as (select max(case when c0 = 1 then e0 end) z0, max(case when c1 = 1 then e1 end) z1, max(m) mm from e)
 select 'f0' features, -1::bigint cell, round(mm + z0 + z1, 7) "value" from r
 union all select distinct '0', c0::bigint, round(e0 - z0, 7) + 0e0 from e, r union all select distinct '1', c1::bigint, round(e1 - z1, 7) + 0e0 from e, r"""


def relativities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feature's relativities as the rating export of a log-link model has them."""
    from ..operators.export import rating_export

    model = demo_model()
    model.objective, model.link = "poisson", "log"
    bins = score.binned_frame(table(spark, sf_dir, "lineitem"), model.axes, ["l_orderkey"])
    bank = explain.explain(model, score.cell_frame(bins, explain.merged_axes(model), ["l_orderkey"]))
    sheet = next(t for t in rating_export(model, bank)["tables"] if t["raw"] == [0])
    return spark.createDataFrame([(c, round(float(v), 9)) for c, v in enumerate(sheet["relativities"])], "cell long, relativity double")


def factored_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the triple kept as boxes: the same function as with dense tables."""
    cells, _ = _bank(spark, sf_dir)
    bank = explain.explain(demo_model(), cells, table_cells=19)  # below the triple's cells and above every pair's
    out = score.bank_scores(cells, bank, ["l_orderkey", "l_linenumber"])
    return out.withColumn("raw_score", rounded(F.col("raw_score")))


def sparse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triple over its budget written as rows, which are the pure table's cells."""
    cells, _ = _bank(spark, sf_dir)
    bank = explain.explain(demo_model(), cells, overflow="sparse", table_cells=19)
    rows = bank.stored[(0, 1, 2)].withColumn("value", rounded(F.col("value"), 9))
    return rows.where("value <> 0").select(*[F.col(f"cell{k}").cast("long").alias(f"cell{k}") for k in range(3)], "value")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100_000).alias("y"), (F.col("o_custkey") % 97 / 40.0 + 0.1).alias("p"), (1 + F.col("o_orderkey") % 3).cast("double").alias("w"), (F.col("o_orderpriority") < "3").cast("int").alias("c")
    )


_PREDICTED = "(select o_orderkey, o_totalprice / 100000 y, o_custkey % 97 / 40.0e0 + 0.1e0 p, (1 + o_orderkey % 3)::double w, (o_orderpriority < '3')::int c from orders)"


def metric(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _predicted(spark, sf_dir)
        if name == "rmse":
            out = metrics.rmse(df, "y", "p")
        elif name == "auc":
            out = metrics.roc_auc(df, "c", "p")
        elif name == "gini":
            out = metrics.ordered_gini(df, "y", "p", "w", "o_orderkey")
        elif name == "lift":
            out = metrics.lift_curve(df, "y", "p", "w", "o_orderkey")
        elif name == "d2":
            out = metrics.d2(df, "y", "p", "w", "poisson")
        else:
            out = metrics.mean_deviance(df, "y", "p", "w", name)
        return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run


_POISSON_TERM = "2 * (case when y > 0 then y * ln(y / {p}) else 0e0 end - (y - {p}))"


def _fit_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Axis]]:
    """Binned orders with an order-three target, whose key is unique."""
    x0, x1, x2 = F.col("o_custkey") % 50, F.col("o_orderkey") % 11, F.col("o_orderkey") % 9
    orders = table(spark, sf_dir, "orders").select("o_orderkey", x0.cast("float").alias("x0"), x1.cast("float").alias("x1"), x2.cast("float").alias("x2"))
    y = 10 + F.when(F.col("x0") <= 20, 1.2).otherwise(-0.4) + F.when(F.col("x1") <= 3, 0.8).otherwise(-0.3) + F.when((F.col("x0") > 20) & (F.col("x1") <= 3) & (F.col("x2") <= 2), 0.9).otherwise(0.0)
    axes = [Axis(i, f"x{i}", np.arange(n - 1) + 0.5) for i, n in enumerate((50, 11, 9))]
    rows = orders.withColumns({"y": y, "w": F.lit(1.0), "off": F.lit(0.0)}).withColumnRenamed("o_orderkey", "rid")
    return score.binned_frame(rows, axes, ["rid", "x0", "x1", "x2", "y", "w", "off"]), axes


def fit_and_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trees, their exact tables, and both scores of every row."""
    rows, axes = _fit_rows(spark, sf_dir)
    rows = staged(spread(rows), "flagship")  # fitted, weighed, checked and scored twice
    model = Booster(axes, config=BoostConfig(n_trees=5, learning_rate=0.5)).fit(rows)
    cells = score.cell_frame(rows, explain.merged_axes(model), ["rid"])
    bank = explain.explain(model, cells)
    by_tree = score.predict(rows, model, ["rid", "y"])
    by_table = score.table_scores(cells, bank, "rid").withColumnRenamed("raw_score", "raw_table")
    return by_tree.join(by_table, "rid").select("rid", "y", F.col("raw_score").alias("raw_tree"), "raw_table", F.abs(F.col("raw_score") - F.col("raw_table")).alias("abs_diff"))


def fitted(**knobs):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, axes = _fit_rows(spark, sf_dir)
        model = Booster(axes, config=BoostConfig(**{"n_trees": 4, "learning_rate": 0.5, **knobs})).fit(rows)
        return score.predict(rows, model, ["rid", "y"]).agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)), 4).alias("rmse"))

    return run


def fit_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short fit, its cell correction, and the tables that still reproduce the scores."""
    rows, axes = _fit_rows(spark, sf_dir)
    model = refit.cell_correction(rows, Booster(axes, config=BoostConfig(n_trees=2, learning_rate=0.5)).fit(rows))
    cells = score.cell_frame(rows, explain.merged_axes(model), ["rid"])
    explain.explain(model, cells)
    return score.predict(rows, model, ["rid", "y"]).agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)), 4).alias("rmse"))


def fit_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of the fits that greedy selection picks from a library of three."""
    rows, axes = _fit_rows(spark, sf_dir)
    library = [BoostConfig(n_trees=n, learning_rate=r) for n, r in ((1, 0.5), (3, 0.3), (3, 0.6))]
    model = refit.select_ensemble(rows, axes, "squared_error", library)
    return score.predict(rows, model, ["rid", "y"]).agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)), 4).alias("rmse"))


def _exact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a target that is constant in each of eight boxes, which one tree can tell exactly."""
    x0, x1, x2 = F.col("o_custkey") % 50, F.col("o_orderkey") % 11, F.col("o_orderkey") % 9
    y = 10 + F.when(x0 <= 20, 1.2).otherwise(-0.4) + F.when(x1 <= 3, 0.8).otherwise(-0.3) + F.when((x0 > 20) & (x1 <= 3) & (x2 <= 2), 0.9).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), x2.cast("double").alias("x2"), y.alias("y"))


_EXACT_SQL = "select o_orderkey, round(10 + case when o_custkey % 50 <= 20 then 1.2e0 else -0.4e0 end + case when o_orderkey % 11 <= 3 then 0.8e0 else -0.3e0 end + case when o_custkey % 50 > 20 and o_orderkey % 11 <= 3 and o_orderkey % 9 <= 2 then 0.9e0 else 0e0 end, 5) prediction from orders"


def fit_exact(**knobs):
    """Predictions of a whole fit, from columns to scores, which has to find the target itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _exact_orders(spark, sf_dir)
        model = BoostedRegressor("o_orderkey", ["x0", "x1", "x2"], **{"n_trees": 2, "learning_rate": 1.0, "ridge": 0.0, **knobs}).fit(df, "y")
        return model.predict(df).select("o_orderkey", rounded(F.col("prediction"), 5).alias("prediction"))

    return run


_PLAIN, _L1 = split.SplitConfig(), split.SplitConfig(l1=200.0, max_delta=0.2)
_FLOOR = split.SplitConfig(min_rows=15_000)

QUERIES = {
    **{f"grad_hess_{n}": grad_hess(n) for n in LOSSES}, **{f"deviance_{n}": deviance(n) for n in LOSSES}, **{f"init_{n}": init_score(n) for n in LOSSES},
    "histogram": hist, "histogram_weighted": hist_weighted, "histogram_two_leaves": hist_two_leaves, "histogram_quantized": hist_quantized, "histogram_arrow": hist_arrow, "histogram_subtract": hist_subtract,
    "split_gain_scan": gain_scan(_PLAIN), "split_gain_two_leaves": gain_scan(_PLAIN, _two_leaves), "best_split": best_split(_PLAIN), "best_split_missing_dir": best_split(_PLAIN, missing=True),
    "best_split_two_leaf_oblivious": best_split(_PLAIN, _two_leaves), "split_credibility": gain_scan(_FLOOR), "split_l1_clamp": gain_scan(_L1),
    "split_monotone": found_split(split.SplitConfig(monotone={0: 1})), "split_budget_prior": found_split(split.SplitConfig(cell_budget=4, budget_power=8.0)), "split_noise": found_split(split.SplitConfig(noise=4e5)),
    "leaf_values": leaf_values, "leaf_path_smooth": leaf_path_smooth, "mvs_sample_topk": mvs_sample, "validation_carve": validation_carve, "subagging": subagging, "bootstrap_weights": bootstrap, "hash_split": hash_split, "claims_join": claims_join, "column_sample": column_sample,
    "tree_score": tree_score, "correction_delta": correction_delta, "dart_rescore": dart_rescore, "reanchor_identity": reanchor("identity"), "reanchor_log": reanchor("log"),
    "ref_weights_uniform": ref_weights("uniform"), "ref_weights_product": ref_weights("product"), "support_counts": support_counts,
    "purify_1d": purified(1), "purify_2d": purified(2), "purify_3d": purified(3), "table_variance_sobol": table_variance, "shap": shap, "faith_shap": faith_shap, "gates": gates,
    "rating_score_lookup": rating_scores, "rating_score_join": rating_join, "rating_rebase": rating_rebase, "relativities": relativities, "factored_box_score": factored_boxes,
    **{f"metric_{n}": metric(n) for n in ("rmse", "auc", "poisson", "gamma", "d2", "lift", "gini")},
    "fit_and_explain": fit_and_explain, "fit_bagged": fitted(n_bags=2, n_trees=2), "fit_dropout": fitted(dart_rate=0.3), "fit_sampled": fitted(subsample=0.5, colsample=0.7), "fit_refined": fitted(leaf_refine_steps=2), "fit_early_stop": fitted(validation_fraction=0.2, early_stopping=2), "fit_ridge": fitted(ridge_refit=True), "fit_corrected": fit_corrected, "fit_selected": fit_selected, "sparse_tables": sparse_tables,
    "fit_exact": fit_exact(), "fit_exact_out_of_bag": fit_exact(n_bags=3, bag_subsample=0.6, cell_refit=refit.CellRefit(10.0, 1.0)),
    "fit_exact_selected": fit_exact(selection=refit.Selection(4, refit.SettingsGrid((0.0, 50.0), (0.1, 1.0), (1,), (3,)), picks=3)),
    "fit_exact_refined": fit_exact(n_trees=1, learning_rate=0.5, leaf_refine_steps=40), "fit_exact_ridge": fit_exact(n_trees=3, learning_rate=0.3, ridge_refit=True),
    "fit_exact_early_stop": fit_exact(n_trees=6, validation_fraction=0.2, early_stopping=1), "fit_exact_sampled": fit_exact(n_trees=1, subsample=0.5), "fit_exact_bootstrap": fit_exact(n_bags=3, bootstrap=True),
}

_LOW = "select o_orderkey from (select o_orderkey, row_number() over (order by {h}, o_orderkey) i, count(*) over () n from orders) where i <= {k}"
_U = "({h} + 1) / 9223372036854775808e0"
_PURE = purify_sql()
_CONC = "(select sum(w * (cy - wy / 2)) * 2 / (sum(w) * sum(wy)) - 1 g from (select w, w * y wy, sum(w * y) over (order by {o} desc, o_orderkey) cy from {t}))"

ORACLE = {
    **{f"grad_hess_{n}": f"select l_orderkey, l_linenumber, round({g}, 6) + 0e0 g, round(greatest({h}, 1e-16), 6) + 0e0 h from {_lossy_sql(n)}" for n, (g, h) in GRADIENT_SQL.items()},
    **{f"deviance_{n}": f"select round(sum({d}), 3) deviance from {_lossy_sql(n)}" for n, d in DEVIANCE_SQL.items()},
    **{f"init_{n}": f"{s} {_lossy_sql(n)}" + ")" * (n == "logistic") for n, s in INIT_SQL.items()},
    "histogram": f"select {_SHOW} from ({_hist_sql()})",
    "histogram_weighted": f"select {_SHOW} from ({_hist_sql('wt')})",
    "histogram_two_leaves": f"select {_SHOW} from ({_hist_sql(leaf=_LEAF_SQL)})",
    "histogram_quantized": f"select {_SHOW.replace(', 5)', ', 3)')} from ({_hist_sql()})",
    "histogram_arrow": f"select {_SHOW} from ({_hist_sql()})",
    "histogram_subtract": f"select {_SHOW.removeprefix('leaf::bigint leaf, ')} from ({_hist_sql(where='b0 > 2')})",
    "split_gain_scan": scan_shown_sql(), "split_gain_two_leaves": scan_shown_sql(leaf=_LEAF_SQL), "best_split": best_sql(), "best_split_missing_dir": best_sql(missing=True), "best_split_two_leaf_oblivious": best_sql(leaf=_LEAF_SQL),
    "split_monotone": found_sql("round(gain_, 9)", rising=0),
    "split_budget_prior": found_sql(f"round(gain_, 9) * (case axis {' '.join(f'when {a} then {n}' for a, n in DATA_BINS.items())} end / 4e0) ** (case when (case axis {' '.join(f'when {a} then {n}' for a, n in DATA_BINS.items())} end) > 4 then -8 else 0 end)"),
    "split_noise": found_sql(f"round(gain_, 9) + ({seed.row_hash_sql('axis * 4294967296 + (bin_le - 1) * 2 + missing_left::int', 7, 3, seed.STAGES['noise'])} / 9223372036854775808e0 - 0.5e0) * 4e5 / 2"),
    "split_credibility": scan_shown_sql(rows=15_000), "split_l1_clamp": scan_shown_sql(l1=200.0, clamp=0.2),
    "leaf_values": f"select (case when b0 <= 2 then 1 else 0 end + case when b1 <= 1 then 2 else 0 end + case when b2 <= 1 then 4 else 0 end)::bigint leaf, round(0.3e0 * -sum(g) / (sum(h) + 1), 6) + 0e0 \"value\" from {_HIST_ROWS} group by 1",
    "leaf_path_smooth": _SMOOTH_SQL,
    "mvs_sample_topk": f"select o_orderkey from (select o_orderkey, row_number() over (order by ln({_U.format(h=seed.row_hash_sql('o_orderkey', 7, 0, seed.STAGES['rows']))}) / sqrt((o_totalprice / 1000 - 150) ** 2 + 1) desc, o_orderkey) i, count(*) over () n from orders) where i <= ceil(0.1e0 * n)",
    "validation_carve": _LOW.format(h=seed.row_hash_sql("o_orderkey", 7, 0, seed.STAGES["holdout"]), k="ceil(0.2e0 * n)"),
    "subagging": _LOW.format(h=seed.row_hash_sql("o_orderkey", 7, 3, seed.STAGES["bags"]), k="ceil(0.5e0 * n)"),
    "tree_score": f"select l_orderkey, l_linenumber, round({SCORE_SQL}, 6) + 0e0 raw_score from ({BINNED_SQL})",
    "correction_delta": f"select l_orderkey, l_linenumber, round(0.25e0 + (b0 * 4 + b1) / 8, 6) + 0e0 raw_score from ({BINNED_SQL})",
    "dart_rescore": f"select l_orderkey, l_linenumber, round({' + '.join(['0.25e0', _tree_sql(0.5, TREES[0][1]), _tree_sql(*TREES[1]), _tree_sql(0.5, TREES[2][1])])}, 6) + 0e0 raw_score from ({BINNED_SQL})",
    "reanchor_identity": f"select round(avg(l_quantity - ({SCORE_SQL})), 6) + 0e0 shift from ({BINNED_SQL})",
    "reanchor_log": f"select round(ln(sum(l_quantity) / sum(exp({SCORE_SQL}))), 6) + 0e0 shift from ({BINNED_SQL})",
    "ref_weights_uniform": " union all ".join(f"select {r}::bigint raw, unnest(range(0, {n})) cell, round(1e0 / {n}, 9) w" for r, n in _N.items()),
    "ref_weights_product": f"select raw::bigint raw, cell, round(w, 9) w from ({WEIGHTS_SQL})",
    "support_counts": f"select {cell_sql(0)}::bigint c0, {cell_sql(1)}::bigint c1, count(*) n from ({BINNED_SQL}) group by 1, 2",
    "purify_1d": f"with {_PURE} " + " union all ".join([*[_effect_sql((r,)) for r in range(3)], "select distinct 'f0', -1::bigint, -1::bigint, -1::bigint, round(m, 9) from e"]),
    "purify_2d": f"with {_PURE} " + " union all ".join(_effect_sql(u) for u in ((0, 1), (0, 2), (1, 2))),
    "purify_3d": f"with {_PURE} {_effect_sql((0, 1, 2))}",
    "table_variance_sobol": _VARIANCE_SQL,
    "shap": _SHAP_SQL,
    "faith_shap": f"with {_PURE} select distinct c0::bigint c0, c1::bigint c1, round(e01, 9) + 0e0 \"value\" from e",
    "gates": "select true reconstruction, true mass, true purity, true variance, true three_way",
    "rating_score_lookup": f"select l_orderkey, l_linenumber, round({SCORE_SQL}, 6) + 0e0 raw_score from ({BINNED_SQL})",
    "rating_score_join": _JOIN_SQL,
    "rating_rebase": _REBASE_SQL,
    "relativities": f"with {_PURE} select distinct c0::bigint cell, round(exp(e0), 9) relativity from e",
    "factored_box_score": f"select l_orderkey, l_linenumber, round({SCORE_SQL}, 6) + 0e0 raw_score from ({BINNED_SQL})",
    **{f"fit_exact{k}": _EXACT_SQL for k in ("", "_out_of_bag", "_selected", "_refined", "_ridge", "_early_stop", "_sampled", "_bootstrap")},
    "bootstrap_weights": f"select o_orderkey, (case {' '.join(f'when u < {x!r}e0 then {k}' for k, x in enumerate(sampling.POISSON_STEPS.tolist()))} else 8 end)::bigint times from (select o_orderkey, {seed.row_hash_sql('o_orderkey', 7, 0, seed.STAGES['bags'])} / 9223372036854775808e0 u from orders)",
    "hash_split": f"select o_orderkey, row_number() over (order by {seed.row_hash_sql('o_orderkey', 7, 1, seed.STAGES['holdout'])}, o_orderkey) <= greatest(count(*) over () // 4, 1) held from orders",
    "claims_join": "select o_orderkey, round(coalesce(a, 0e0), 2) + 0e0 amount, least(o_custkey % 7, 4)::bigint claims, round(least(o_totalprice / 300000, 1e0), 9) + 0e0 as years from orders left join (select l_orderkey, sum(l_extendedprice) a from lineitem where l_quantity > 25 group by 1) on l_orderkey = o_orderkey",
    "sparse_tables": f"with {_PURE} select c0::bigint cell0, c1::bigint cell1, c2::bigint cell2, round(e012, 9) \"value\" from e where abs(round(e012, 9)) > 0",
    "metric_rmse": f"select round(sqrt(avg((y - p) * (y - p))), 6) rmse from {_PREDICTED}",
    "metric_auc": f"select round(sum(case when c = 1 then below + ties / 2e0 end) / (sum(c)::double * (count(*) - sum(c))), 6) auc from (select c, sum(1 - c) over (order by p range between unbounded preceding and current row) - sum(1 - c) over (partition by p) below, sum(1 - c) over (partition by p) ties from {_PREDICTED})",
    "metric_poisson": f"select round(sum(w * {_POISSON_TERM.format(p='p')}) / sum(w), 6) deviance from {_PREDICTED}",
    "metric_gamma": f"select round(sum(w * 2 * (y / p - 1 - ln(y / p))) / sum(w), 6) deviance from {_PREDICTED}",
    "metric_d2": f"select round(1 - sum(w * {_POISSON_TERM.format(p='p')}) / sum(w * {_POISSON_TERM.format(p='m')}), 6) d2 from {_PREDICTED}, (select sum(w * y) / sum(w) m from {_PREDICTED})",
    "metric_lift": f"with r as (select *, row_number() over (order by p desc, o_orderkey) - 1 i, count(*) over () n from {_PREDICTED}), b as (select bucket, r.* from r, (select unnest(range(1, 11)) bucket) where i >= (bucket - 1) * n // 10 and i < bucket * n // 10) select bucket, count(*) n, round(sum(w * y) / sum(w), 6) mean_y, round(sum(w * p) / sum(w), 6) mean_pred, round(sum(w * y) / sum(w) / (select sum(w * y) / sum(w) from r), 6) lift from b group by 1",
    "metric_gini": f"select round(a.g / b.g, 6) gini from {_CONC.format(o='p', t=_PREDICTED)} a, {_CONC.format(o='y', t=_PREDICTED)} b",
}
