"""Ranked lexical search by block-max pruning over a forward index in document order.

*Index.* One pass over the documents keeps, for the terms that a set of queries asks for, each document's counts; numbers
of documents and terms are taken over all documents and all their terms. Rows are then sorted by id and cut into blocks,
ranges of at most ``DOCS`` documents and about ``POSTINGS`` postings. A block holds its documents' postings (the forward
index, with the term's share of the score at weight one) and for each of its terms the largest such share.

*Search.* A block's bound for a query is the sum of weight times largest share over the query's terms: no document in it
scores more. First the ``FIRST`` blocks of the highest bounds of each query are scored; the score of rank ``TOP`` there is
a threshold that the whole search starts from. Then every task sorts its blocks by bound for each query and scores them
until the bound falls below the threshold, which rises with what the task finds. A block whose bound equals the threshold
is scored, so ties are settled by id exactly and nothing is lost.

Queries are dealt with in sets of at most ``ITEMS`` items and ``TERMS`` terms (an item of more is a set of its own), so
what a task holds of them is bounded, whatever the number of queries; each set reads the documents once.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, slices, staged

TOP = 20
DOCS = 8
POSTINGS = 1 << 14
ITEMS = 1024
TERMS = 200_000
FIRST = 24
_BLOCKS = 2048
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_SPLIT).split() if text else []


@dataclass
class QuerySet:
    """Queries over one vocabulary: query ``k`` has ``terms[starts[k]:starts[k + 1]]``, each once, ``times`` in its text."""

    items: list[int]
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, list[bytes]]]) -> QuerySet:
        vocabulary: dict[bytes, int] = {}
        counted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in found) for _, found in rows]
        starts = np.concatenate(([0], np.cumsum([len(c) for c in counted])))
        flat = [np.array(sorted(c.items()), np.int64).reshape(-1, 2) for c in counted]
        both = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
        return QuerySet([i for i, _ in rows], vocabulary, starts, both[:, 0], both[:, 1])


def query_sets(items: Iterator[tuple[int, str | None]]) -> Iterator[QuerySet]:
    """Sets of bounded size; items without a term are left out, as nothing can match them."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for item, text in items:
        found = terms(text)
        if held and (len(held) == ITEMS or size + len(found) > TERMS):
            yield QuerySet.of(held)
            held, size = [], 0
        if found:
            held.append((item, found))
            size += len(found)
    if held:
        yield QuerySet.of(held)


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's number of terms, and its counts of those in ``vocabulary``."""
    ddl = "doc_id long, n long, terms array<int>, tfs array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, counts = [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                sizes.append(len(found))
                counts.append([(vocabulary[t], n) for t, n in Counter(found).items() if t in vocabulary])
            flat = np.array([c for own in counts for c in own], np.int32).reshape(-1, 2)
            held = [len(c) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(flat[:, 0], held, pa.int32()), _lists(flat[:, 1], held, pa.int32())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


_BLOCK_DDL = "block long, ids array<long>, sizes array<int>, terms array<int>, shares array<int>, top_terms array<int>, top_shares array<int>"


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, documents: int, words: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted documents. A block's number is that of its first document; numbers rise with the ids."""
    held: list[tuple] = []
    at, postings = TaskContext.get().partitionId() << 40, 0

    def block() -> pa.RecordBatch:
        term, share = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        names, inverse = np.unique(term, return_inverse=True)
        most = np.zeros(len(names), np.int32)
        np.maximum.at(most, inverse, share)
        columns = [[at], [[h[0] for h in held]], [[len(h[1]) for h in held]], *([c] for c in (term, share, names.astype(np.int32), most))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for batch in slices(batches, 1024):
        for doc, n, term, tf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            tf = tf.values.to_numpy().astype(np.int64)
            length = 100 - 25 + 25 * n * documents // words
            held.append((doc, term.values.to_numpy(), (1_000_000_000 * tf // (1000 * tf + 12 * length)).astype(np.int32)))
            postings += len(tf)
            if len(held) == DOCS or postings >= POSTINGS:
                yield block()
                at, postings, held = at + len(held), 0, []
    if held:
        yield block()


class Scorer:
    """Bounds and scores of blocks for a set of queries with their terms' weights."""

    def __init__(self, queries: QuerySet, weights: np.ndarray):
        self.queries = queries
        self.worth = queries.times * weights[queries.terms]
        self.room = np.zeros(len(queries.vocabulary), np.int64)

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """``[block, query]``."""
        out = np.zeros((batch.num_rows, len(self.queries.items)), np.int64)
        for row, (names, most) in enumerate(zip(batch.column("top_terms"), batch.column("top_shares"), strict=True)):
            names = names.values.to_numpy()
            self.room[names] = most.values.to_numpy()
            out[row] = np.add.reduceat(self.room[self.queries.terms] * self.worth, self.queries.starts[:-1])
            self.room[names] = 0
        return out

    def by_term(self, batch: pa.RecordBatch, row: int) -> tuple:
        """The postings of a block, ordered by term."""
        term, share, sizes = (batch.column(c)[row].values.to_numpy() for c in ("terms", "shares", "sizes"))
        order = np.argsort(term, kind="stable")
        names, starts, counts = np.unique(term[order], return_index=True, return_counts=True)
        return names, starts, counts, np.repeat(np.arange(len(sizes)), sizes)[order], share[order].astype(np.int64), len(sizes)

    def scores(self, postings: tuple, query: int) -> np.ndarray:
        """Score of each document of a block."""
        names, starts, counts, doc, share, size = postings
        lo, hi = self.queries.starts[query : query + 2]
        asked = self.queries.terms[lo:hi]
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        hit = names[at] == asked
        at, worth = at[hit], self.worth[lo:hi][hit]
        own = counts[at]
        rows = np.arange(own.sum()) + np.repeat(starts[at] - np.cumsum(own) + own, own)
        out = np.zeros(size, np.int64)
        np.add.at(out, doc[rows], share[rows] * np.repeat(worth, own))
        return out


class Best:
    """The best documents found so far for each query; equal scores go to the document that stands first."""

    def __init__(self, thresholds: np.ndarray):
        self.least = np.maximum(thresholds, 1)
        self.heaps: list[list[tuple]] = [[] for _ in thresholds]

    def add(self, query: int, scores: np.ndarray, block: int, ids: list) -> None:
        heap = self.heaps[query]
        for k in np.flatnonzero(scores >= self.least[query]).tolist():
            heapq.heappush(heap, (int(scores[k]), -block - k, ids[k]))
            if len(heap) > TOP:
                heapq.heappop(heap)
        if len(heap) == TOP:
            self.least[query] = max(self.least[query], heap[0][0])

    def rows(self, items: list[int], schema: pa.Schema) -> pa.RecordBatch:
        flat = [(item, score, -at, doc) for item, heap in zip(items, self.heaps, strict=True) for score, at, doc in heap]
        columns = zip(*flat, strict=True) if flat else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_HIT_DDL = "item long, score long, at long, doc_id long"


def _search(blocks: DataFrame, scorer: Scorer) -> DataFrame:
    """The best hits of each task for each query, ``TOP`` or more over all tasks if there are so many."""
    items = scorer.queries.items
    number = {item: k for k, item in enumerate(items)}
    bound_ddl, hit_schema = "item long, block long, bound long", arrow_schema(_HIT_DDL)
    bound_schema = arrow_schema(bound_ddl)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, len(items)), np.int64)
        names = np.zeros((0, len(items)), np.int64)
        for batch in slices(batches, _BLOCKS):
            kept = np.concatenate([kept, scorer.bounds(batch)])
            names = np.concatenate([names, np.repeat(batch.column("block").to_numpy()[:, None], len(items), 1)])
            order = np.argsort(-kept, axis=0, kind="stable")[:FIRST]
            kept, names = np.take_along_axis(kept, order, 0), np.take_along_axis(names, order, 0)
        own = np.broadcast_to(np.array(items, np.int64), kept.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).ravel()) for c in (own, names, kept)], schema=bound_schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(np.zeros(len(items), np.int64))
        for batch in slices(batches):
            for row, asked in enumerate(batch.column("asked").to_pylist()):
                postings = scorer.by_term(batch, row)
                for item in asked:
                    best.add(number[item], scorer.scores(postings, number[item]), batch.column("block")[row].as_py(), batch.column("ids")[row].as_py())
        yield best.rows(items, hit_schema)

    bounds = blocks.select("block", "top_terms", "top_shares").mapInArrow(highest, bound_ddl).where("bound > 0")
    leading = bounds.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))).where(F.col("n") <= FIRST)
    asked = leading.groupBy("block").agg(F.collect_list("item").alias("asked"))
    # at most FIRST rows for each of the ITEMS queries of a set, so the broadcast is bounded
    sampled = blocks.join(F.broadcast(asked), "block").select("block", "ids", "sizes", "terms", "shares", "asked").mapInArrow(first, _HIT_DDL)
    ranked = sampled.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "at"))).where(F.col("n") == TOP)
    # one number per query of the set
    thresholds = np.zeros(len(items), np.int64)
    for r in ranked.select("item", "score").collect():
        thresholds[number[r.item]] = r.score

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(thresholds)
        for batch in slices(batches, _BLOCKS):
            bounds = scorer.bounds(batch)
            postings: dict[int, tuple] = {}
            ids: dict[int, list] = {}
            for query in np.flatnonzero((bounds >= best.least).any(0)).tolist():
                for row in np.argsort(-bounds[:, query], kind="stable").tolist():
                    if bounds[row, query] < best.least[query]:
                        break
                    if row not in postings:
                        postings[row], ids[row] = scorer.by_term(batch, row), batch.column("ids")[row].as_py()
                    best.add(query, scorer.scores(postings[row], query), batch.column("block")[row].as_py(), ids[row])
        yield best.rows(items, hit_schema)

    return blocks.mapInArrow(rest, _HIT_DDL)


def _found(docs: DataFrame, queries: QuerySet, id_col: str, text_col: str) -> DataFrame:
    """``item, rank, doc_id, score`` for one set of queries, stored."""
    spark = docs.sparkSession
    forward = staged(forward_rows(docs, queries.vocabulary, id_col, text_col).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "search-forward")
    documents, words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(queries.vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the set
        held[r.t] = r["count"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
    by_id = forward.where(F.size("terms") > 0).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_last(), "row")
    ordered = by_id.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "row").select("doc_id", "n", "terms", "tfs")
    schema = arrow_schema(_BLOCK_DDL)
    blocks = staged(ordered.mapInArrow(lambda batches: _cut(batches, schema, documents, words), _BLOCK_DDL), "search-blocks")
    hits = _search(blocks, Scorer(queries, weights))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "at"))
    return staged(hits.withColumn("rank", rank).where(F.col("rank") <= TOP).select("item", "rank", "doc_id", "score"), "search-found")


def _texts(items: DataFrame) -> Iterator[tuple[int, str | None]]:
    for r in items.select("item", "text").toLocalIterator():
        yield r.item, r.text


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the 20 best documents of each row of ``queries`` among all of ``docs``.

    Scores are whole numbers and exact; only those above 0 count, ranks start at 1, and equal scores go to the smaller
    id. Null texts have no terms; documents without a term are not counted, items without one get no rows. Repeated rows
    of ``docs`` are documents of their own; a null id stands last among equal scores. Of equal rows of ``queries`` one
    counts; one item with two texts is ranked for each. Empty tables give an empty result; other columns are ignored,
    whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    asked = queries.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")).distinct()
    items = staged(asked.withColumn("item", F.monotonically_increasing_id()), "search-items")
    found = [_found(docs, some, id_col, text_col) for some in query_sets(_texts(items))]
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
docs AS (SELECT row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM split WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings CROSS JOIN totals GROUP BY term
),
lengths AS (SELECT row, doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM docs CROSS JOIN totals),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY item_id, term),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row) GROUP BY item_id, row, doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
