"""Near-duplicate vectors by lattice hashing, exact on the pairs it finds.

*Tables.* A table projects a unit vector on ``8 * blocks`` Gaussian directions and decodes each eight of them to the
nearest point of the E8 lattice; those points and the table name the vector's cell. Besides its own cell a vector visits
the neighbouring ones (a point moved by one of the 240 shortest lattice vectors) that lie nearest to it. Two vectors
meet where one visits the other's own cell.

*Recall.* Projections are Gaussian, so whether two vectors meet depends on their angle and not on the data. Each row of
``SETTINGS`` misses fewer than one in 5000 pairs that lie exactly at the threshold, and fewer still of closer ones (a
test measures it). Larger tables of vectors get finer cells, chosen by the largest number of vectors that share a label.

*Work* is dealt out by blocks: the visitors and owners of a cell are cut into parts of ``BLOCK`` by a hash, and each part
of visitors meets each part of owners, so no cell is held whole. Cosines are taken inside a task, and a pair counts
where it meets first, which both vectors tell alike anywhere: cells come from integer arithmetic, whatever the batch.
Only link counts and a spanning forest leave a task, never pairs. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, join_spread, partitions, staged
from .simhash import _least, components

THRESHOLD = 0.98
BLOCK = 512
#: Up to so many vectors of one label: lattice blocks a table, scale at a distance of 0.2, cells visited, tables.
SETTINGS = (
    (20_000, 1, 2.0, 4, 4),
    (2_000_000, 1, 3.0, 4, 7),
    (200_000_000, 2, 2.0, 4, 11),
    (1 << 62, 3, 2.0, 4, 20),
)
_FINE = 1 << 20
_CHUNK = 16384


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            found.append([a if k == i else b if k == j else 0 for k in range(8)])
    found += [list(signs) for signs in itertools.product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(found, np.int64)


_SHORTEST = shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are whole and of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x``, doubled."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


@dataclass
class Lattice:
    blocks: int
    scale: float
    probes: int
    tables: int
    seed: int = 23
    drawn: dict = field(default_factory=dict, repr=False)

    def _directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.drawn:
            rng = np.random.default_rng((self.seed, size, self.blocks))
            width = 8 * self.blocks * self.tables
            self.drawn[size] = np.rint(rng.normal(size=(size, width)) * 1024).astype(np.int64), rng.integers(1, 1 << 62, width) * 2 + 1
        return self.drawn[size]

    def visits(self, unit: np.ndarray, ring: np.ndarray) -> np.ndarray:
        """Cells each unit vector visits, ``[vector, table, probe]``; its own comes first. ``ring`` keeps labels apart."""
        directions, odd = self._directions(unit.shape[1])
        exact = (np.rint(unit * _FINE).astype(np.int64) @ directions) * (self.scale / np.sqrt(8) / _FINE / 1024)
        flat = exact.reshape(-1, 8)
        point = decode(flat)
        left = np.rint((flat - point / 2) * _FINE).astype(np.int64).reshape(len(unit), self.tables, self.blocks, 8)
        odd = odd.reshape(self.tables, self.blocks, 8)
        own = (point.reshape(left.shape) * odd).sum((2, 3)) + (ring * 0x1E3779B97F4A7C15)[:, None] + np.arange(self.tables) * 0x3F58476D1CE4E5B9
        if self.probes == 1:
            return own[:, :, None]
        # how much nearer each neighbour is; the rank breaks ties, so the choice is the same everywhere
        gain = (left @ _SHORTEST.T).reshape(len(unit), self.tables, -1)
        gain = gain * 1024 - np.arange(gain.shape[2])
        best = np.argpartition(-gain, self.probes - 2, axis=2)[:, :, : self.probes - 1]
        moved = (odd @ _SHORTEST.T).reshape(self.tables, -1)
        return np.concatenate([own[:, :, None], own[:, :, None] + moved[np.arange(self.tables)[None, :, None], best]], 2)


def lattice(vectors: int, threshold: float = THRESHOLD) -> Lattice:
    """The lattice for at most so many vectors of one label; cells are scaled with the distance at the threshold."""
    _, blocks, scale, probes, tables = next(s for s in SETTINGS if vectors <= s[0])
    return Lattice(blocks, scale * 0.2 / np.sqrt(2 - 2 * threshold), probes, tables)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine; their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, each pair summed in the same order whatever else there is."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.RecordBatch | pa.Table, np.ndarray]]:
    vectors = batch.column("v")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        yield batch.take(pa.array(own)), _scaled(flat.astype(np.float64).reshape(-1, size))


def _met_first(cells: Lattice, unit: np.ndarray, ring: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether the visit of ``i`` to ``j`` in ``table`` is the first of the visits by which the two meet."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    visits = cells.visits(unit[rows], ring[rows])
    a, b = at[: len(i)], at[len(i) :]
    there = (visits[a] == visits[b][:, :, :1]).any(2)
    back = (visits[b] == visits[a][:, :, :1]).any(2)
    first = (there | back).argmax(1)
    pairs = np.arange(len(i))
    return (first == table) & there[pairs, first] & (~back[pairs, first] | (rank[i] < rank[j]))


_FOUND_DDL = "a long, b long, n long"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _links(cells: Lattice, threshold: float, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links among whole groups of rows: ``(class, null, weight of its partners)`` and edges ``(class, class, 0)``."""
    for part, x in _by_length(rows):
        cell, block, share, table, c, ring, weight = (part.column(k).to_numpy() for k in ("cell", "block", "part", "t", "c", "ring", "weight"))
        asks = part.column("asks").to_numpy()
        unit = _unit(x)
        new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(share) != 0)) + 1
        bounds = [0, *new.tolist(), len(cell)]
        found = []
        for lo, hi in itertools.pairwise(bounds):
            mid = lo + int(asks[lo:hi].sum())
            i, j = np.nonzero(unit[lo:mid] @ unit[mid:hi].T >= threshold - 1e-9)
            if len(i):
                found.append((i + lo, j + mid))
        if not found:
            continue
        i, j = (np.concatenate(f) for f in zip(*found, strict=True))
        own = (c[i] != c[j]) & (ring[i] == ring[j]) & (table[i] == table[j])
        i, j = i[own], j[own]
        names, node = np.unique(c, return_inverse=True)
        partners, label = np.zeros(len(names), np.int64), np.arange(len(names))
        for lo in range(0, len(i), _CHUNK):
            a, b = i[lo : lo + _CHUNK], j[lo : lo + _CHUNK]
            near = cosines(x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            if not len(a):
                continue
            first = _met_first(cells, unit, ring, a, b, table[a], c)
            a, b = a[first], b[first]
            np.add.at(partners, node[a], weight[b])
            np.add.at(partners, node[b], weight[a])
            label = _least(len(names), np.concatenate([np.arange(len(names)), node[a]]), np.concatenate([label, node[b]]))
        some, moved = np.flatnonzero(partners), np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.nulls(len(some), pa.int64()), pa.array(partners[some])], schema=_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]]), pa.array(np.zeros(len(moved), np.int64))], schema=_FOUND)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same sorted rows, cut where a group ends; a group has at most two blocks, so little waits."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = [rows.column(k).to_numpy() for k in ("cell", "block", "part")]
        cut = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1]) + 1 if any((k != k[-1]).any() for k in keys) else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None:
        yield held


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in double precision
    is at least ``threshold``. ``n_links`` counts the other vectors linked directly, equal ones included, and
    ``component_id`` is the smallest id reachable by links. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows without an id, link with nothing and are kept. Rows that repeat an id, its label
    and its vector are one vector, and each of them comes back; an id with two vectors is two. Other columns are
    ignored, whatever their names; an empty table gives an empty result. Labels are compared by a 64-bit hash.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    takes = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    marked = own.withColumn("takes", takes).withColumn("ring", F.when(F.col("takes"), F.xxhash64("label", F.size("v")))).withColumn("h", F.when(F.col("takes"), F.xxhash64("ring", "v")))
    valid = marked.where("takes").select("vec_id", "h", "ring", "v")
    classes = staged(
        valid.distinct().groupBy("h", "ring", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first")).withColumn("c", F.monotonically_increasing_id()),
        "lattice-classes",
    )
    cells = lattice(classes.groupBy("ring").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, threshold)
    visit_ddl = "cell long, t int, c long, own boolean"
    visit_schema = arrow_schema(visit_ddl)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                for rows, x in _by_length(batch.slice(lo, 1024)):
                    found = cells.visits(_unit(x), rows.column("ring").to_numpy())
                    shape = found.shape
                    t, probe = (np.broadcast_to(k, shape).ravel() for k in (np.arange(shape[1])[None, :, None], np.arange(shape[2])))
                    c = np.repeat(rows.column("c").to_numpy(), shape[1] * shape[2])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(t.astype(np.int32)), pa.array(c), pa.array(probe == 0)], schema=visit_schema)

    visits = staged(classes.select("c", "ring", "v").mapInArrow(visit, visit_ddl), "lattice-visits")
    sizes = visits.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("owners")).where("owners > 0 and n > 1")
    met = join_spread(visits, staged(sizes, "lattice-cells"), "cell", F.xxhash64("c"))
    parts, blocks = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("n", "owners"))
    share, block = F.pmod(F.xxhash64("c", F.lit(3)), parts).cast("int"), F.pmod(F.xxhash64("c", F.lit(5)), blocks).cast("int")
    asking = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("block"), share.alias("part"), F.lit(True).alias("asks")))
    owning = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(block.alias("block"), p.alias("part"), F.lit(False).alias("asks")))
    dealt = met.select("cell", "t", "c", F.explode(F.concat(asking, F.when(F.col("own"), owning).otherwise(F.slice(owning, 1, 0)))).alias("d")).select("cell", "t", "c", "d.*")
    keys = ["cell", "block", "part"]
    full = dealt.join(classes.select("c", "ring", "weight", "v"), "c").repartition(partitions(vectors.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("asks"))
    ordered = full.select("cell", "t", "c", "block", "part", "asks", "ring", "weight", "v")
    found = staged(ordered.mapInArrow(lambda batches: (b for rows in _groups(batches) for b in _links(cells, threshold, rows)), _FOUND_DDL), "lattice-links")

    partners = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("partners"))
    stars = components(found.where("b is not null").select("a", "b"))
    roots = stars.select("root").distinct().select("root", F.col("root").alias("node"))
    members = staged(stars.select("root", "node").unionByName(roots).join(classes.select(F.col("c").alias("node"), "first"), "node"), "lattice-members")
    smallest = members.groupBy("root").agg(F.min("first").alias("least"))
    named = members.join(smallest, "root").select(F.col("node").alias("c"), "least")
    told = classes.join(partners, "c", "left").join(named, "c", "left").select("h", "ring", "v", (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = valid.join(told, ["h", "ring", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not takes").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: Brute force over all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
fine AS (
  SELECT DISTINCT vec_id, label, e FROM rows_
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.label = b.label AND len(a.e) = len(b.e) AND (a.vec_id <> b.vec_id OR a.e <> b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
),
reached(a, b) AS (
  SELECT DISTINCT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT r.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(r.vec_id, coalesce(l.b, r.vec_id)) AS component_id,
  coalesce(r.vec_id = least(r.vec_id, coalesce(l.b, r.vec_id)), true) AS kept
FROM rows_ r LEFT JOIN counted c ON c.a = r.vec_id LEFT JOIN least l ON l.a = r.vec_id
"""
