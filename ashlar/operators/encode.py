"""Target statistics of categorical columns: frozen for serving, leakage-free for training."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seed
from .prefix import running_sums

RARE = "__rare__"
# Fixed values of automatic smoothing.
_AUTO_CAP, _AUTO_FLOOR = 1e6, 1e-12


@dataclass(frozen=True)
class EncodeConfig:
    leakage: str = "kfold"  # kfold, loo or ordered
    folds: int = 5
    permutations: int = 4
    smoothing: float | None = None  # None: automatic
    target: str = "mean"  # mean or log_mean
    least: float = 10.0

    def __post_init__(self) -> None:
        if self.leakage not in ("kfold", "loo", "ordered") or self.target not in ("mean", "log_mean"):
            raise ValueError("unknown leakage or target statistic")
        if self.folds < 2 or self.permutations < 1 or self.least < 0 or (self.smoothing is not None and self.smoothing < 0):
            raise ValueError("folds >= 2, permutations >= 1, least and smoothing >= 0")


@dataclass
class CatEncoder:
    """The frozen map: label or rare member to encoding; any other label gets ``base``."""

    base: float
    levels: dict[str, float]
    members: dict[str, str] = field(default_factory=dict)
    borders: list[float] = field(default_factory=list)

    def encode(self, label: str | None) -> float:
        label = "None" if label is None else label
        return self.levels.get(self.members.get(label, label), self.base)


def row_terms(y: Column, w: Column, exposure: Column, target: str = "mean") -> tuple[Column, Column]:
    """A row's share of numerator and denominator."""
    return (w * y, w * exposure) if target == "mean" else (w * F.log(y), w)


def prepared(df: DataFrame, level: str, y: str, key: str, config: EncodeConfig, w: Column | None = None, exposure: Column | None = None) -> DataFrame:
    """``key, level, s, d``: row terms, with rare levels under one label. A null level is the label 'None'."""
    s, d = row_terms(F.col(y).cast("double"), F.lit(1.0) if w is None else w, F.lit(1.0) if exposure is None else exposure, config.target)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(level).cast("string"), F.lit("None")).alias("level"), s.alias("s"), d.alias("d"))
    return collapse_rare(rows, config.least)


def collapse_rare(rows: DataFrame, least: float) -> DataFrame:
    """Levels whose denominator stays below ``least`` become one. Sums per level are made before they meet the rows."""
    if least <= 0:
        return rows.withColumn("label", F.col("level"))
    sums = rows.groupBy("level").agg(F.sum("d").alias("_d"))
    return rows.join(sums, "level").withColumn("label", F.when(F.col("_d") < least, F.lit(RARE)).otherwise(F.col("level"))).drop("_d")


def base_rate(rows: DataFrame) -> float:
    row = rows.agg(F.sum("s"), F.sum("d")).first()
    if not row[1]:
        raise ValueError("no weight to encode with")
    return row[0] / row[1]


def auto_smoothing(sums: DataFrame, rows: DataFrame, base: float) -> float:
    """Within over between variance of the level means, at most 1e6."""
    between = sums.agg(F.sum(F.col("d") * F.pow(F.col("s") / F.col("d") - base, F.lit(2.0))), F.sum("d")).first()
    means = sums.select("label", (F.col("s") / F.col("d")).alias("_m"))
    rate = F.col("s") / F.col("d")
    within = rows.where("d > 0").join(means, "label").agg(F.sum(F.col("d") * F.pow(rate - F.col("_m"), F.lit(2.0))), F.sum("d")).first()
    b, v = (between[0] or 0.0) / (between[1] or 1.0), (within[0] or 0.0) / (within[1] or 1.0)
    if b <= _AUTO_FLOOR:
        return 0.0 if v <= _AUTO_FLOOR else _AUTO_CAP
    return min(v / b, _AUTO_CAP)


def smoothed(s: Column, d: Column, m: float, base: float) -> Column:
    return F.when(d + m > 0, (s + m * base) / (d + m)).otherwise(F.lit(base))


def level_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))


def level_encodings(rows: DataFrame, m: float, base: float) -> DataFrame:
    """``label, enc, d``: the frozen encoding of each level."""
    return level_sums(rows).select("label", smoothed(F.col("s"), F.col("d"), m, base).alias("enc"), "d")


def kfold_encodings(rows: DataFrame, m: float, base: float, folds: int, base_seed: int) -> DataFrame:
    """``key, enc``: each row from the rows outside its fold. Folds are sums of sums, so a hot level costs no task more."""
    dealt = rows.withColumn("fold", seed.row_hash(F.col("key"), base_seed, 0, seed.STAGES["folds"], folds))
    cells = dealt.groupBy("label", "fold").agg(F.sum("s").alias("fs"), F.sum("d").alias("fd"))
    sums = cells.groupBy("label").agg(F.sum("fs").alias("ts"), F.sum("fd").alias("td"))
    out = cells.join(sums, "label").select("label", "fold", (F.col("ts") - F.col("fs")).alias("os"), (F.col("td") - F.col("fd")).alias("od"))
    enc = F.when(F.col("od") > 0, smoothed(F.col("os"), F.col("od"), m, base)).otherwise(F.lit(base))
    return dealt.join(out, ["label", "fold"]).select("key", enc.alias("enc"))


def loo_encodings(rows: DataFrame, m: float, base: float) -> DataFrame:
    """``key, enc``: each row from all others of its level."""
    sums = rows.groupBy("label").agg(F.sum("s").alias("ts"), F.sum("d").alias("td"), F.count("*").alias("n"))
    s, d = F.col("ts") - F.col("s"), F.col("td") - F.col("d")
    enc = F.when((F.col("n") > 1) & (d > 0), smoothed(s, d, m, base)).otherwise(F.lit(base))
    return rows.join(sums, "label").select("key", enc.alias("enc"))


#: Ranges of hashes into which the order within a level is cut; each is a task's group.
RANGES = 256


def ordered_encodings(rows: DataFrame, m: float, base: float, permutations: int, base_seed: int) -> DataFrame:
    """``key, enc``: each row from those before it in hash order, averaged over permutations.

    The order runs through a level, but no level is one group: it is cut into ranges of hashes, whose sums are carried on
    from range to range, a row per level and range. Within a range rows add up one by one.
    """
    out, terms = rows, []
    for p in range(permutations):
        order, part = f"h{p}", f"part{p}"
        out = out.withColumn(order, seed.row_hash(F.col("key"), base_seed, p, seed.STAGES["folds"])).withColumn(part, F.shiftright(order, 63 - RANGES.bit_length() + 1))
        sums = out.groupBy("label", part).agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
        earlier = Window.partitionBy("label").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select("label", part, F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("cs"), F.coalesce(F.sum("d").over(earlier), F.lit(0.0)).alias("cd"))
        before = Window.partitionBy("label", part).orderBy(order, "key").rowsBetween(Window.unboundedPreceding, -1)
        s, d = (F.col(c) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) for c, x in (("cs", "s"), ("cd", "d")))
        out = out.join(carried, ["label", part]).withColumn(f"e{p}", F.when(d > 0, smoothed(s, d, m, base)).otherwise(F.lit(base))).drop("cs", "cd")
        terms.append(F.col(f"e{p}"))
    return out.select("key", (sum(terms[1:], terms[0]) / permutations).alias("enc"))


def fisher_bins(levels: DataFrame, most: int = 254) -> DataFrame:
    """``label, enc, bin``: ordinal bins by (encoding, label); ties share one. Ranks are running counts by ranges."""
    distinct = levels.select("enc").distinct()
    total = distinct.count()
    ranked = running_sums(distinct, ["enc"], {"r": F.lit(1)})
    bin_ = 1 + F.floor((F.col("r") - 1) * min(total, most) / max(total, 1))
    return levels.join(ranked.select("enc", bin_.cast("long").alias("bin")), "enc").select("label", "enc", "bin")


def fisher_borders(levels: DataFrame, most: int = 254) -> DataFrame:
    """``border``: float midpoints where the ordinal bin changes; a row per bin meets in one place."""
    ends = fisher_bins(levels, most).groupBy("bin").agg(F.min("enc").alias("low"), F.max("enc").alias("high"))
    marked = ends.withColumn("before", F.lag("high").over(Window.partitionBy().orderBy("bin")))
    return marked.where("before is not null").select(((F.col("before") + F.col("low")) / 2).cast("float").cast("double").alias("border")).distinct()


def fit_encoder(df: DataFrame, level: str, y: str, key: str, config: EncodeConfig = EncodeConfig(), base_seed: int = 0, w: Column | None = None, exposure: Column | None = None) -> tuple[CatEncoder, DataFrame]:
    """The frozen encoder and ``key, enc`` for training.

    Levels come to the driver as part of the model: one entry for each level that is not rare, and rare members.
    """
    rows = prepared(df, level, y, key, config, w, exposure)
    base = base_rate(rows)
    sums = level_sums(rows)
    m = auto_smoothing(sums, rows, base) if config.smoothing is None else config.smoothing
    levels = level_encodings(rows, m, base)
    borders = sorted(r["border"] for r in fisher_borders(levels).collect())
    table = {r["label"]: r["enc"] for r in levels.collect()}
    members = {r["level"]: RARE for r in rows.where(F.col("label") == RARE).select("level").distinct().collect()} if RARE in table else {}
    if config.leakage == "kfold":
        train = kfold_encodings(rows, m, base, config.folds, base_seed)
    elif config.leakage == "loo":
        train = loo_encodings(rows, m, base)
    else:
        train = ordered_encodings(rows, m, base, config.permutations, base_seed)
    return CatEncoder(float(base), {k: float(np.float64(v)) for k, v in table.items()}, members, borders), train


def serve_encoded(df: DataFrame, level: str, encoder: CatEncoder) -> DataFrame:
    """Adds ``enc``: the frozen encoding, ``base`` for labels never seen. The level table is the model's own."""
    rows = [(k, float(v)) for k, v in encoder.levels.items() if k != RARE] + [(k, float(encoder.levels[RARE])) for k in encoder.members]
    table = df.sparkSession.createDataFrame(rows or [("", None)], "_label string, _enc double")
    keyed = df.withColumn("_label", F.coalesce(F.col(level).cast("string"), F.lit("None")))
    return keyed.join(table, "_label", "left").withColumn("enc", F.coalesce("_enc", F.lit(encoder.base))).drop("_label", "_enc")
