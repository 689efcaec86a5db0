"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources get shares of a word budget by weight. A source whose share exceeds ``max_epochs`` times its size is clamped
there, and the excess goes to the others by weight until no source is above its cap. A source's target is then met by
whole repetitions of all its documents and one fractional repetition: documents in an order fixed by a seeded hash,
whole ones while they fit and the first words of the next, so that the words taken equal the target rounded to a word.

The fractional repetition never sorts a source: documents fall into ``BINS`` hash bins, bins are summed before the
shuffle, and only the one bin per source where the target is crossed is ordered document by document. A source with a
third of all rows therefore costs no task more than ``BINS`` sums and one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

BINS = 4096
#: A plan of up to this many sources, under 1 MB, is broadcast.
FEW_SOURCES = 10_000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, seed: str, id_col: str, text_col: str) -> DataFrame:
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.withColumns({"_size": word_count(F.col(text_col)), "_order": order, "_tie": F.xxhash64(text_col)}).withColumn(
        "_bin", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    )


def source_plan(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    source_col: str = "source",
) -> DataFrame:
    """One row per source: size, target, whole repetitions, and where in hash order the fractional one ends.

    ``sized`` has ``_size`` and ``_bin``. There is one row per source after the first aggregate, so the ordered
    windows over sources see a handful of rows whatever the corpus.
    """
    bins = sized.groupBy(source_col, "_bin").agg(F.sum("_size").alias("_w"))
    by_source = bins.groupBy(source_col).agg(F.sum("_w").alias("_source_size"))
    every, by_name = Window.partitionBy(), Window.partitionBy().orderBy(F.col(source_col).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    filled = (
        by_source.withColumn("_weight", weight)
        .withColumn("_budget", F.sum("_source_size").over(every) * F.lit(float(budget)))
        .withColumn("_cap", F.col("_source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    rising = Window.partitionBy().orderBy("_ratio", F.col(source_col).asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    # if all sources before this one are clamped, the rest fill to this level per unit of weight
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(
        rising.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = filled.withColumn("_level", level).withColumn("_rank", F.row_number().over(rising))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))
    filled = filled.withColumn("_at", F.min(fits).over(every)["_level"]).withColumn(
        "_target", F.coalesce(F.least("_cap", F.col("_at") * F.col("_weight")), F.col("_cap"))
    )
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(1)
    planned = filled.select(
        source_col,
        "_source_size",
        "_target",
        whole.cast("long").alias("_whole"),
        F.round(F.col("_target") - whole * F.col("_source_size")).cast("long").alias("_rest"),
    )
    running = Window.partitionBy(source_col).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        bins.withColumn("_before", F.coalesce(F.sum("_w").over(running), F.lit(0)))
        .withColumnRenamed(source_col, "_s")
        .join(planned, F.col("_s").eqNullSafe(F.col(source_col)))
        .groupBy("_s")
        .agg(F.min(F.when(F.col("_before") + F.col("_w") > F.col("_rest"), F.struct("_bin", "_before"))).alias("_cut"))
    )
    return planned.join(crossing, F.col("_s").eqNullSafe(F.col(source_col))).select(
        F.col("_s"),
        "_source_size",
        "_target",
        "_whole",
        F.coalesce(F.col("_cut._bin"), F.lit(BINS)).alias("_cut_bin"),
        (F.col("_rest") - F.coalesce(F.col("_cut._before"), F.lit(0))).alias("_left"),
    )


def _taken(sized: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    """Adds ``_whole`` (repetitions of the whole document) and ``_part`` (words of a further, partial one).

    The plan has a row per source. It goes to every task only where it has at most ``FEW_SOURCES`` rows; otherwise
    Spark joins it by shuffling, and splits the hot source.
    """
    plan = staged(plan, "mix-plan")
    if plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s")
    inside = joined.where(F.col("_bin") != F.col("_cut_bin")).withColumn(
        "_part", F.when(F.col("_bin") < F.col("_cut_bin"), F.col("_size")).otherwise(F.lit(0).cast("long"))
    )
    in_order = Window.partitionBy(source_col).orderBy("_order", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.coalesce(F.sum("_size").over(in_order), F.lit(0))
    edge = joined.where(F.col("_bin") == F.col("_cut_bin")).withColumn(
        "_part", F.greatest(F.least(F.col("_size"), room), F.lit(0)).cast("long")
    )
    return inside.unionByName(edge)


def mix_counts(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **policy) -> DataFrame:
    """Per document the words the mix takes: ``doc_id, size, source_size, target, taken``.

    Null texts have size 0 and a null source is a source of its own, last in order. Rows that repeat a document are
    documents of their own; which of two equal rows is cut is the same either way. An empty table gives an empty
    result. Other columns of ``docs`` are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = staged(_keyed(docs, seed, "doc_id", "text").drop("text"), "mix-sizes")
    return _taken(sized, source_plan(sized, **policy), "source").select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"),
    )


def mix_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **policy) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per repetition, the last one of a source cut to its words.

    Documents without words follow the whole repetitions of their source. ``docs`` is read more than once, so pass a
    stored table. Its columns travel in one struct, so none of their names can clash with the working columns.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    keyed = _keyed(packed, seed, "_id", "_text").drop("_id")
    sized = staged(keyed.select("_source", "_size", "_bin"), "mix-sizes")
    taken = _taken(keyed, source_plan(sized, source_col="_source", **policy), "_source")
    copies = F.col("_whole") + F.when((F.col("_size") > 0) & (F.col("_part") == F.col("_size")), 1).otherwise(0)
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    words = F.regexp_extract_all("_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("_part").cast("int")), "")
    texts = F.concat(
        F.array_repeat(F.struct(F.lit(False).alias("cut")), copies.cast("int")),
        F.when(cut, F.array(F.struct(F.lit(True).alias("cut")))).otherwise(F.array().cast("array<struct<cut:boolean>>")),
    )
    rows = taken.withColumn("_copy", F.explode(texts))
    return rows.select(
        *[
            (F.when(F.col("_copy.cut"), head).otherwise(F.col("_text")) if c == text_col else F.col("_row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
         md5('mix' || coalesce(cast(doc_id as varchar), '')) o
  from documents
), s as (
  select source, sum(size)::bigint source_size,
         ([3e0, 1e0, 2e0])[((row_number() over (order by source nulls last) - 1) % 3) + 1] weight
  from d group by source
), r as (
  select *, sum(source_size) over () * 1.5e0 budget, source_size * 2e0 cap, source_size * 2e0 / weight ratio from s
), l as (
  select *, (budget - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0e0))
            / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) lvl,
         row_number() over (order by ratio, source nulls last) k
  from r
), t as (
  select source, source_size, coalesce(least(cap, (select arg_min(lvl, k) from l where lvl <= ratio) * weight), cap) target from l
), u as (
  select *, case when source_size > 0 then floor(target / source_size) else 1 end whole from t
), x as (
  select d.*, u.source_size, u.target, u.whole, round(u.target - u.whole * u.source_size) rest,
         coalesce(sum(size) over (partition by d.source order by o, size rows between unbounded preceding and 1 preceding), 0) before
  from d join u on d.source is not distinct from u.source
)
select doc_id, size, source_size, target, cast(whole * size + greatest(least(size, rest - before), 0) as bigint) taken from x
"""
