"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length. A table hashes a vector by ``k`` Gaussian projections cut into cells of width ``w``.
A query visits, besides its own cell, the neighbouring cells in the order of their estimated success: perturbations are
ranked by how close the query lies to the cell boundaries they cross. The candidates of all tables are merged and
reranked by exact cosine in double precision.

*Parameters* are chosen on the driver from ``SETTINGS``, for each length of vectors, by recall and by share of candidates
on a sample of at most ``SAMPLE`` vectors (those with the smallest seeded hash of their id); every vector is indexed.

*Recall of each query.* How likely a setting finds a neighbour depends on its distance alone, as projections are Gaussian.
A missed neighbour is nearer than the last one found, so a query whose last neighbour lies where that chance is at least
``CHANCE`` expects to have found that share of its neighbours. All other queries (outliers, mostly), those that found
fewer neighbours than there are, and those of a length that the sample does not show or for which no setting reaches
``RECALL`` on it, are compared with all vectors of their length, in blocks of the same kind.

*Work* is dealt out by blocks: a cell of more than ``BLOCK`` vectors is split into blocks by a hash of the id, its queries
likewise, and each part of the queries meets each block. A task multiplies the queries of a block with its vectors and
keeps a few per query, so pairs never become rows, no cell is held whole, and nothing is capped. Equal vectors are one
entry that knows its smallest ids, as many as a result can use.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, join_spread, staged

SAMPLE = 2000
BLOCK = 1024
RECALL = 0.93
CHANCE = 0.9
#: (projections, cell width, tables, probes); the last visits nearly everything and suits any data.
SETTINGS = (
    (16, 1.0, 8, 16),
    (12, 1.0, 8, 24),
    (10, 1.5, 6, 32),
    (8, 1.5, 4, 40),
    (8, 2.0, 4, 40),
    (6, 2.0, 3, 40),
    (6, 2.0, 2, 60),
    (5, 2.0, 2, 40),
    (4, 2.0, 2, 20),
    (4, 2.0, 2, 30),
    (4, 2.5, 2, 30),
    (3, 3.0, 2, 27),
)


def perturbations(k: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks among a query's 2k sorted boundary distances, in order of expected cost; the empty one first.

    A set that crosses both boundaries of one projection is left out.
    """
    n = 2 * k
    cost = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (n + 1 - j) / (k + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, n + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(n - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
    return out


@dataclass
class Hasher:
    k: int
    width: float
    tables: int
    probes: int
    seed: int = 19

    def _drawn(self, table: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng((self.seed, table, dim, self.k))
        return rng.normal(size=(dim, self.k)), rng.uniform(0, self.width, self.k), rng.integers(1, 1 << 62, self.k) * 2 + 1

    def _base(self, table: int, dim: int) -> int:
        """Keeps the cells of tables and lengths apart."""
        return (table * 1_000_003 + dim) * 0x1E3779B97F4A7C15 % (1 << 62)

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Cell of each unit vector."""
        a, b, odd = self._drawn(table, unit.shape[1])
        at = np.floor((unit @ a + b) / self.width).astype(np.int64)
        return (at * odd).sum(1) + self._base(table, unit.shape[1])

    def probed(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Cells each query visits, ``[query, probe]``, most promising first."""
        a, b, odd = self._drawn(table, unit.shape[1])
        exact = (unit @ a + b) / self.width
        at = np.floor(exact).astype(np.int64)
        inside = exact - at
        own = (at * odd).sum(1) + self._base(table, unit.shape[1])
        ranked = np.argsort(np.concatenate([inside, 1 - inside], 1), axis=1, kind="stable")
        out = []
        for ranks in perturbations(self.k, self.probes):
            key = own.copy()
            for r in ranks:
                key += np.where(ranked[:, r] < self.k, -1, 1) * odd[ranked[:, r] % self.k]
            out.append(key)
        return np.stack(out, 1)


    def chance(self, distance: float, trials: int = 2000) -> float:
        """Chance that a query visits the cell of a vector at this distance in some table, by simulated projections."""
        rng = np.random.default_rng((self.seed, self.k, self.probes))
        inside, step = rng.uniform(size=(trials, self.k)), rng.normal(size=(trials, self.k)) * distance / self.width
        moved = np.floor(inside + step).astype(np.int64)
        ranked = np.argsort(np.concatenate([inside, 1 - inside], 1), axis=1, kind="stable")
        met = np.zeros(trials, bool)
        for ranks in perturbations(self.k, self.probes):
            visited = np.zeros_like(moved)
            for r in ranks:
                visited[np.arange(trials), ranked[:, r] % self.k] += np.where(ranked[:, r] < self.k, -1, 1)
            met |= (visited == moved).all(1)
        return 1 - (1 - float(met.mean())) ** self.tables

    def sure_cosine(self) -> float:
        """The smallest cosine at which the chance to find a vector is at least ``CHANCE``; 1 if there is none."""
        near, far = 0.0, 2.0
        for _ in range(12):
            middle = (near + far) / 2
            near, far = (middle, far) if self.chance(middle) >= CHANCE else (near, middle)
        return 1 - near * near / 2


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, summed in the same order whatever else is in the block."""
    dot = (a * b).sum(1)
    return np.clip(dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))), -1.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose(sample: np.ndarray, k: int = 5) -> Hasher | None:
    """The setting with the fewest candidates among those that reach ``RECALL`` on the sample, None if none does."""
    if len(sample) < 2:
        return Hasher(*SETTINGS[-1])
    unit = _unit(sample)
    queries = np.arange(0, len(unit), max(1, len(unit) // 200))
    score = unit[queries] @ unit.T
    score[np.arange(len(queries)), queries] = -9
    k = min(k, len(unit) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    found = []
    for setting in SETTINGS:
        hasher = Hasher(*setting)
        seen = np.zeros((len(queries), len(unit)), bool)
        for table in range(hasher.tables):
            cells = hasher.cells(unit, table)
            names, inverse = np.unique(cells, return_inverse=True)
            probes = hasher.probed(unit[queries], table)
            at = np.minimum(np.searchsorted(names, probes), len(names) - 1)
            visited = np.zeros((len(queries), len(names)), bool)
            hit = names[at] == probes
            visited[np.repeat(np.arange(len(queries)), probes.shape[1])[hit.ravel()], at[hit]] = True
            seen |= visited[:, inverse]
        recall = seen[np.arange(len(queries))[:, None], best].mean()
        enough = seen.sum(1).min() > k
        if recall >= RECALL and enough:
            found.append((float(seen.mean()), hasher))
    return min(found, key=lambda x: x[0])[1] if found else None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is the cosine; equal scores go to the smaller id. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows without an id; only vectors of equal length meet. Equal vectors
    are neighbours of each other. Of rows that repeat an id and its vector one counts. Other columns are ignored; an
    empty table gives an empty result. Each query gets ``k`` rows, or as many as there are other vectors of its length.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0)).distinct()
    smallest = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    # two steps, so that copies in a hot vector are cut to a few before they meet
    partly = valid.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(smallest.alias("some"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked"))
    classes = staged(
        partly.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("ids"), F.max("asked").alias("asked")).withColumn("c", F.element_at("ids", 1)),
        "vector-classes",
    )
    sample = classes.orderBy(F.xxhash64("c", F.lit(41)), "c").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)
    chosen = {width: choose(np.array(some, float), k) for width, some in by_width.items()}
    sure = {width: hasher.sure_cosine() for width, hasher in chosen.items() if hasher}
    usual = Hasher(*SETTINGS[-1])
    hashers = {width: hasher for width, hasher in chosen.items() if hasher}

    def by_length(batch: pa.RecordBatch, column: str):
        sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            yield rows, _unit(_matrix(rows.column(column)))

    cell_ddl = "cell long, c long"
    cell_schema = arrow_schema(cell_ddl)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in by_length(batch, "v"):
                hasher = hashers.get(unit.shape[1], usual)
                for t in range(hasher.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hasher.cells(unit, t)), rows.column("c")], schema=cell_schema)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in by_length(batch, "v"):
                hasher, ids = hashers.get(unit.shape[1], usual), rows.column("c").to_numpy()
                for t in range(hasher.tables):
                    cells = hasher.probed(unit, t)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(ids, cells.shape[1]))], schema=cell_schema)

    hit_ddl = "c long, ids array<long>, scores array<double>"
    hit_schema = arrow_schema(hit_ddl)

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_schema.empty_table()
        x, y = _matrix(left.column("q").combine_chunks()), _matrix(right.column("e").combine_chunks())
        asked_by, members = left.column("c").to_pylist(), right.column("ids").to_pylist()
        unit, spare = _unit(y), min(len(y), k + 12)
        out = []
        for lo in range(0, len(x), 512):
            rough = _unit(x[lo : lo + 512]) @ unit.T
            near = np.argpartition(-rough, spare - 1, axis=1)[:, :spare]
            for q, found in enumerate(near):
                exact = cosines(np.broadcast_to(x[lo + q], (spare, x.shape[1])), y[found])
                ranked = sorted((-s, i) for s, j in zip(exact.tolist(), found.tolist(), strict=True) for i in members[j])[: k + 1]
                out.append((asked_by[lo + q], [i for _, i in ranked], [-s for s, _ in ranked]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), hit_schema.types, strict=True)], schema=hit_schema)

    def search(indexed: DataFrame, probes: DataFrame, name: str) -> DataFrame:
        """``c, best``: for the probing classes the best hits in the cells they probe. Pass stored tables."""
        per_cell = indexed.groupBy("cell").agg(F.count("*").alias("entries"))
        sizes = staged(per_cell.join(probes.groupBy("cell").agg(F.count("*").alias("queries")), "cell"), f"cells-{name}")
        blocks, parts = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("entries", "queries"))
        dealt = join_spread(indexed, sizes.withColumn("n", F.col("entries")), "cell", F.xxhash64("c"))
        entries = dealt.select("cell", "c", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        asking = join_spread(probes, sizes.withColumn("n", F.col("queries")), "cell", F.xxhash64("c"))
        visits = asking.select("cell", "c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("c", F.lit(3)), parts).cast("int").alias("part"))
        keys = ["cell", "block", "part"]
        left = visits.join(classes.select("c", F.col("v").alias("q")), "c").groupBy(*keys)
        hits = left.cogroup(entries.join(classes.select("c", F.col("v").alias("e"), F.col("ids").alias("ids")), "c").groupBy(*keys)).applyInArrow(rerank, hit_ddl)
        merged = hits.select("c", F.explode(F.arrays_zip("ids", "scores")).alias("h")).groupBy("c", F.col("h.ids").alias("id")).agg(F.max("h.scores").alias("s"))
        first = Window.partitionBy("c").orderBy(F.col("s").desc(), "id")
        best = merged.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        return staged(best.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("n", "id", "s"))).alias("best")), f"best-{name}")

    asked = classes.where("asked = 1").select("c", "v")
    indexed = staged(classes.select("c", "v").mapInArrow(index, cell_ddl), "vector-cells")
    probes = staged(asked.mapInArrow(probe, cell_ddl).distinct(), "vector-probes")
    top = search(indexed, probes, "probed")

    # one row per length: how many neighbours there are, counted as far as a result can use them
    lengths = classes.groupBy(F.size("v").alias("width")).agg(F.sum(F.size("ids")).alias("members"))
    held = asked.select("c", F.size("v").alias("width")).join(top, "c", "left").join(lengths, "width")
    short = F.coalesce(F.size("best"), F.lit(0)) < F.least(F.lit(k + 1), "members")
    # a length outside the sample has no such cosine, so its queries are doubtful whatever they found
    certain = F.element_at(F.create_map(*[F.lit(x) for pair in sure.items() for x in pair]), F.col("width")) if sure else F.lit(None).cast("double")
    doubtful = (F.col("members") > k + 1) & ~F.coalesce(F.element_at("best", -1)["s"] >= certain, F.lit(False))
    again = staged(held.where(short | doubtful).select(F.col("width").cast("long").alias("cell"), "c"), "vector-again")
    if not again.isEmpty():
        whole = staged(classes.select(F.size("v").cast("long").alias("cell"), "c"), "vector-every")
        top = top.join(again, "c", "left_anti").unionByName(search(whole, again, "exact"))

    queries = valid.where(F.col("vec_id") % every == 0).join(classes.select("v", "c"), "v").select("vec_id", "c")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("vec_id")), 1, k)
    return (
        queries.join(top, "c")
        .select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "b"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.s").alias("score"))
    )
