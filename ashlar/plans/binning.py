"""Queries of binning, grids and target statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seed
from ..operators import encode, grids, score
from ..session import table

# Borders of the demonstration grids.
BORDERS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.03, 0.06], "l_tax": [0.02, 0.05]}


def wide(name: str):
    """A feature as the float it is binned as."""
    return F.col(name).cast("float").cast("double")


def floats(values: list[float]) -> list[float]:
    import numpy as np

    return [float(np.float32(v)) for v in values]


def case_sql(x: str, borders: list[float]) -> str:
    whens = " ".join(f"when {x} <= {b!r}e0::float::double then {k + 1}" for k, b in enumerate(borders))
    return f"(case when {x} is null or isnan({x}) then 0 {whens} else {len(borders) + 1} end)"


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with the bins ``b0 b1 b2`` of three features, the canonical target ``y`` and price and quantity."""
    li = table(spark, sf_dir, "lineitem")
    y = (
        F.lit(10.0)
        + F.when(F.col("l_quantity") <= 20.0, 1.2).otherwise(-0.4)
        + F.when(F.col("l_discount") <= 0.03, 0.8).otherwise(-0.3)
        + F.when(F.col("l_tax") <= 0.02, 0.5).otherwise(-0.1)
        + F.when((F.col("l_quantity") <= 20.0) & (F.col("l_discount") > 0.03), 0.7).otherwise(-0.2)
        + F.when((F.col("l_quantity") > 20.0) & (F.col("l_discount") <= 0.03) & (F.col("l_tax") <= 0.02), 0.9).otherwise(0.0)
    )
    bins = [grids.bin_expression(wide(c), floats(b)).alias(f"b{i}") for i, (c, b) in enumerate(BORDERS.items())]
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", *bins, y.alias("y"))


BINNED_SQL = "select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, " + ", ".join(f"{case_sql(f'{c}::float::double', b)} b{i}" for i, (c, b) in enumerate(BORDERS.items())) + """,
 10.0e0 + case when l_quantity <= 20.0e0 then 1.2e0 else -0.4e0 end + case when l_discount <= 0.03e0 then 0.8e0 else -0.3e0 end
 + case when l_tax <= 0.02e0 then 0.5e0 else -0.1e0 end + case when l_quantity <= 20.0e0 and l_discount > 0.03e0 then 0.7e0 else -0.2e0 end
 + case when l_quantity > 20.0e0 and l_discount <= 0.03e0 and l_tax <= 0.02e0 then 0.9e0 else 0.0e0 end y
 from lineitem"""


def rounded(x, digits: int = 6):
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def bin_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).groupBy(*[F.col(f"b{i}").cast("long").alias(f"b{i}") for i in range(3)]).agg(F.count("*").alias("n"))


def bin_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") == 3, None).when(F.col("l_linenumber") == 4, float("nan")).when(F.col("l_linenumber") == 5, float("inf")).when(F.col("l_linenumber") == 6, float("-inf")).otherwise(wide("l_quantity"))
    b = grids.bin_expression(x, BORDERS["l_quantity"])
    return table(spark, sf_dir, "lineitem").select("l_linenumber", b.cast("long").alias("bin")).groupBy("l_linenumber", "bin").agg(F.count("*").alias("n"))


def grid_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.midpoint_borders(grids.distinct_values(table(spark, sf_dir, "lineitem"), "l_discount"))


def grid_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.quantile_borders(grids.distinct_values(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 32)


def grid_quantile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.quantile_borders(grids.distinct_values(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), 32)


def grid_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole grid, refilled: the borders of the order totals."""
    found = grids.build_grid(table(spark, sf_dir, "orders"), "o_totalprice", config=grids.GridConfig(64))
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(found)], "k int, border double")


def grid_refill_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column in which most rows are zero, so that quantiles collapse and the rest is refilled."""
    excess = F.greatest(F.col("o_totalprice") - 200_000.0, F.lit(0.0))
    found = grids.build_grid(table(spark, sf_dir, "orders").select(excess.alias("x")), "x", config=grids.GridConfig(64))
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(found)], "k int, border double")


def grid_rare_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grids.build_grid(table(spark, sf_dir, "orders"), "o_totalprice", config=grids.GridConfig(64, min_data_per_bin=40))
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(found)], "k int, border double")


def quantile_sql(weight: str, x: str = "l_extendedprice", source: str = "lineitem", bins: int = 32) -> str:
    return f"""
with d as (select {x}::float::double x, sum({weight}) w from {source} group by 1),
c as (select x, sum(w) over (order by x) cum, sum(w) over (order by x) - w prev, lead(x) over (order by x) nx, sum(w) over () total from d),
q as (select k, x, nx, cum, k * total / {bins} t, prev from c, (select unnest(range(1, {bins})) k) where k * total / {bins} <= cum and k * total / {bins} > prev)
select distinct (case when cum = t then (x + coalesce(nx, x)) / 2 else x end)::float::double border from q"""


def refill_sql(x: str, source: str, bins: int) -> str:
    """The tree of all cuts by rows, and of its intervals those with most rows."""
    return f"""
with recursive v as (select {x}::float::double x from {source}),
r as (select x, (sum(n) over (order by x) - n)::bigint first, (sum(n) over (order by x))::bigint last from (select x, count(*) n from v group by x)),
b as ({quantile_sql('1.0e0', x, source, bins)}),
e as (select 0::bigint edge union select count(*) from v union select (select count(*) from v where x < border) from b),
p as (select edge lo, lead(edge) over (order by edge) hi from e),
tree(lo, hi, depth, cut) as (
  select lo, hi, 0, case when last < hi and (first <= lo or last - m <= m - first) then last when first > lo then first end
  from (select *, least(greatest(lo + ((hi - lo + 1) // 2), lo + 1), hi - 1) m from p where hi - lo > 1) join r on first < m and m <= last
  union all
  select lo, hi, depth, case when last < hi and (first <= lo or last - m <= m - first) then last when first > lo then first end
  from (select *, least(greatest(lo + ((hi - lo + 1) // 2), lo + 1), hi - 1) m from (
      select lo, cut hi, depth + 1 depth from tree where cut is not null and cut - lo > 1
      union all select cut, hi, depth + 1 from tree where cut is not null and hi - cut > 1)) join r on first < m and m <= last),
picked as (select cut, row_number() over (order by hi - lo desc, lo, depth) i from tree where cut is not null),
cuts as (select ((f.x + l.x) / 2)::float::double border from picked join r f on f.first = cut join r l on l.last = cut where i <= {bins - 1} - (select count(*) from b))
select (row_number() over (order by border) - 1)::int k, border from (select border from b union select border from cuts)"""


def collapse_sql(x: str, source: str, bins: int, least: int) -> str:
    """From left to right, each border with enough rows since the last one kept and enough behind it."""
    return f"""
with recursive b as (select border, row_number() over (order by border) i, (select count(*) from {source} where {x}::float::double <= border) upto, (select count(*) from {source}) total from ({quantile_sql('1.0e0', x, source, bins)})),
walk(i, begun, border, kept) as (
  select 0::bigint, 0::bigint, null::double, false
  union all select b.i, case when b.upto - begun >= {least} and b.total - b.upto >= {least} then b.upto else begun end, b.border, b.upto - begun >= {least} and b.total - b.upto >= {least}
  from walk join b on b.i = walk.i + 1)
select (row_number() over (order by border) - 1)::int k, border from walk where kept"""


def _rows(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("lv", F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), (F.col("o_custkey") % 37).cast("string")))
    return encode.prepared(orders.withColumn("yy", F.col("o_totalprice") / 1000.0), "lv", "yy", "o_orderkey", encode.EncodeConfig(least=least))


ROWS_SQL = "select o_orderkey key, substr(o_orderpriority, 1, 1) || '-' || (o_custkey % 37)::varchar level, o_totalprice / 1000.0e0 s, 1.0e0 d from orders"


def labelled_sql(least: float) -> str:
    return f"rows_ as (select r.*, case when sum(d) over (partition by level) < {least} then '{encode.RARE}' else level end label from ({ROWS_SQL}) r), base as (select sum(s) / sum(d) b from rows_)"


def target_stat_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).agg(rounded(F.sum("s") / F.sum("d")).alias("base"))


def _full(spark: SparkSession, sf_dir: str, least: float, m: float | None) -> DataFrame:
    rows = _rows(spark, sf_dir, least)
    base = encode.base_rate(rows)
    m = encode.auto_smoothing(encode.level_sums(rows), rows, base) if m is None else m
    return encode.level_encodings(rows, m, base).select("label", rounded(F.col("enc")).alias("enc"), F.col("d").alias("weight"))


def target_stat_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir, 0.0, 20.0)


def target_stat_auto_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir, 0.0, None)


def target_stat_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir, 80.0, 20.0)


def target_stat_log_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = encode.prepared(orders, "o_orderpriority", "o_totalprice", "o_orderkey", encode.EncodeConfig(target="log_mean", least=0.0))
    return encode.level_encodings(rows, 0.0, 0.0).select("label", rounded(F.col("enc")).alias("enc"))


def target_stat_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return encode.kfold_encodings(rows, 20.0, encode.base_rate(rows), 5, 7).select("key", rounded(F.col("enc")).alias("enc"))


def target_stat_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return encode.loo_encodings(rows, 20.0, encode.base_rate(rows)).select("key", rounded(F.col("enc")).alias("enc"))


def target_stat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return encode.ordered_encodings(rows, 20.0, encode.base_rate(rows), 2, 7).select("key", rounded(F.col("enc")).alias("enc"))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.round(F.avg("p_retailprice"), 4).alias("enc"))


BRANDS_SQL = "select p_brand label, round(avg(p_retailprice), 4) enc from part group by 1"


def fisher_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fisher_bins(_brands(spark, sf_dir), 10)


def encoder_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fisher_borders(_brands(spark, sf_dir), 10)


def serve_encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = encode.CatEncoder(5.0, {"1-URGENT": 1.0, "2-HIGH": 2.0, encode.RARE: 9.0}, {"5-LOW": encode.RARE})
    served = encode.serve_encoded(table(spark, sf_dir, "orders"), "o_orderpriority", encoder)
    return served.select("o_orderkey", "enc")


def serve_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serve-time binning in Arrow, numeric and categorical axes together."""
    import numpy as np

    from ..operators.model import Axis

    encoder = encode.CatEncoder(5.0, {"1-URGENT": 1.0, "2-HIGH": 2.0, encode.RARE: 9.0}, {"5-LOW": encode.RARE}, [1.5, 7.0])
    axes = [Axis(0, "o_totalprice", np.array([50_000.0, 150_000.0, 300_000.0])), Axis(1, "o_orderpriority", np.array(encoder.borders), encoder)]
    out = score.binned_frame(table(spark, sf_dir, "orders"), axes, ["o_orderkey"])
    return out.select("o_orderkey", F.col("b0").cast("long").alias("b0"), F.col("b1").cast("long").alias("b1"))


_FOLD = seed.row_hash_sql("key", 7, 0, seed.STAGES["folds"], 5)
_SMOOTH = "(({s}) + 20.0e0 * b) / (({d}) + 20.0e0)"


def _ordered_sql() -> str:
    terms = []
    for p in range(2):
        over = f"over (partition by label order by h{p}, key rows between unbounded preceding and 1 preceding)"
        terms.append(f"case when coalesce(sum(d) {over}, 0e0) > 0 then {_SMOOTH.format(s=f'sum(s) {over}', d=f'sum(d) {over}')} else b end")
    hashes = ", ".join(f"{seed.row_hash_sql('key', 7, p, seed.STAGES['folds'])} h{p}" for p in range(2))
    return f"with {labelled_sql(0)}, h as (select *, {hashes} from rows_, base) select key, round(({' + '.join(terms)}) / 2, 6) enc from h"


_LEVELS = "lv as (select label, sum(s) s, sum(d) d from rows_ group by 1)"

QUERIES = {
    "bin_numeric": bin_numeric, "bin_missing_nan_inf": bin_missing, "grid_midpoint": grid_midpoint, "grid_quantile": grid_quantile,
    "grid_quantile_weighted": grid_quantile_weighted, "grid_refill": grid_built, "grid_refill_tied": grid_refill_tied, "grid_rare_collapse": grid_rare_collapse,
    "target_stat_base": target_stat_base, "target_stat_full": target_stat_full, "target_stat_auto_smooth": target_stat_auto_smooth,
    "target_stat_rare_collapse": target_stat_rare, "target_stat_log_mean": target_stat_log_mean, "target_stat_kfold": target_stat_kfold,
    "target_stat_loo": target_stat_loo, "target_stat_ordered": target_stat_ordered, "fisher_bins": fisher_bins, "encoder_grid": encoder_grid,
    "serve_encode_unseen": serve_encode_unseen, "serve_bins": serve_bins,
}

_MISSING = "case when l_linenumber = 3 then null when l_linenumber = 4 then 'nan'::double when l_linenumber = 5 then 'inf'::double when l_linenumber = 6 then '-inf'::double else l_quantity end"

ORACLE = {
    "bin_numeric": f"select b0::bigint b0, b1::bigint b1, b2::bigint b2, count(*) n from ({BINNED_SQL}) group by 1, 2, 3",
    "bin_missing_nan_inf": f"select l_linenumber, {case_sql('x', BORDERS['l_quantity'])}::bigint bin, count(*) n from (select l_linenumber, {_MISSING} x from lineitem) group by 1, 2",
    "grid_midpoint": "select distinct ((x + nx) / 2)::float::double border from (select x, lead(x) over (order by x) nx from (select distinct l_discount::float::double x from lineitem)) where nx is not null",
    "grid_quantile": quantile_sql("1.0e0"),
    "grid_quantile_weighted": quantile_sql("l_quantity"),
    "grid_refill": refill_sql("o_totalprice", "orders", 64),
    "grid_refill_tied": refill_sql("greatest(o_totalprice - 200000.0e0, 0.0e0)", "orders", 64),
    "grid_rare_collapse": collapse_sql("o_totalprice", "orders", 64, 40),
    "target_stat_base": f"select round(sum(s) / sum(d), 6) base from ({ROWS_SQL})",
    "target_stat_full": f"with {labelled_sql(0)}, {_LEVELS} select label, round({_SMOOTH.format(s='s', d='d')}, 6) enc, d weight from lv, base",
    "target_stat_auto_smooth": f"""with {labelled_sql(0)}, {_LEVELS},
      v as (select sum(d * (s / d - b) ** 2) / sum(d) between_ from lv, base),
      u as (select sum(r.d * (r.s / r.d - lv.s / lv.d) ** 2) / sum(r.d) within_ from rows_ r join lv using (label)),
      m as (select least(within_ / between_, 1e6) m from u, v)
      select label, round((s + m * b) / (d + m), 6) enc, d weight from lv, base, m""",
    "target_stat_rare_collapse": f"with {labelled_sql(80)}, {_LEVELS} select label, round({_SMOOTH.format(s='s', d='d')}, 6) enc, d weight from lv, base",
    "target_stat_log_mean": "select o_orderpriority label, round(avg(ln(o_totalprice)), 6) enc from orders group by 1",
    "target_stat_kfold": f"""with {labelled_sql(0)}, f as (select *, {_FOLD} fold from rows_),
      c as (select label, fold, sum(s) fs, sum(d) fd from f group by 1, 2), t as (select label, sum(s) ts, sum(d) td from f group by 1)
      select key, round(case when td - fd > 0 then {_SMOOTH.format(s='ts - fs', d='td - fd')} else b end, 6) enc from f join c using (label, fold) join t using (label), base""",
    "target_stat_loo": f"""with {labelled_sql(0)}, t as (select label, sum(s) ts, sum(d) td, count(*) n from rows_ group by 1)
      select key, round(case when n > 1 then {_SMOOTH.format(s='ts - s', d='td - d')} else b end, 6) enc from rows_ join t using (label), base""",
    "target_stat_ordered": _ordered_sql(),
    "fisher_bins": f"select label, enc, (1 + ((dense_rank() over (order by enc) - 1) * least(nd, 10)) // nd)::bigint bin from ({BRANDS_SQL}), (select count(distinct enc) nd from ({BRANDS_SQL}))",
    "encoder_grid": f"""with f as (select distinct enc, (1 + ((dense_rank() over (order by enc) - 1) * least(nd, 10)) // nd)::bigint bin from ({BRANDS_SQL}), (select count(distinct enc) nd from ({BRANDS_SQL})))
      select distinct ((pe + enc) / 2)::float::double border from (select *, lag(enc) over (order by enc) pe, lag(bin) over (order by enc) pb from f) where pb is not null and pb <> bin""",
    "serve_encode_unseen": "select o_orderkey, case o_orderpriority when '1-URGENT' then 1.0e0 when '2-HIGH' then 2.0e0 when '5-LOW' then 9.0e0 else 5.0e0 end enc from orders",
    "serve_bins": f"select o_orderkey, {case_sql('o_totalprice::float::double', [50_000.0, 150_000.0, 300_000.0])}::bigint b0, (case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '5-LOW' then 3 else 2 end)::bigint b1 from orders",
}
