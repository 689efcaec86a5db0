"""Near-duplicate documents by SimHash, with pivot distance tables instead of comparing all pairs.

*Pivot distances.* ``PIVOTS`` reference fingerprints are drawn once. The Hamming distances of a fingerprint to all of
them are its coordinates. A distance to a reference changes by at most the number of bits that change, so a pair whose
coordinates differ by more than 2 anywhere is discarded, and each survivor is verified by counting bits.

*Meeting.* Which fingerprints meet is decided by equal bits: cut into four blocks, two fingerprints at most 2 bits apart
agree in at least two of them, so each goes to a group for each of the six pairs of blocks and no link is lost. A group
of more than ``GROUP`` fingerprints is cut again in the same way, its remaining bits into four blocks: 32, then 48, then
56 of the 64 bits are equal. As copies are one node, the last groups hold at most 256, so no group is ever compared
whole or held in one task, and every group is treated alike, whatever its size.

Equal fingerprints are one node throughout, so copies cost nothing. Only a spanning forest leaves a batch of groups, and
components are found by large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, join_spread, slices, staged

PIVOTS = 64
GROUP = 1024
_BLOCK_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
_SLICE = 65536
_STRIP = 1 << 20
_EDGE_DDL = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority vote over the XXH64 values (seed 42) of a text's word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for lo in range(0, last, _SLICE):
        hi = min(lo + _SLICE, last)
        spans = zip(starts[lo:hi].tolist(), ends[min(shingle, len(words)) - 1 :][lo:hi].tolist(), strict=True)
        hashes = np.array([digest(flat[s:e], 42) for s, e in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > last, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the 64 bits of each whole text as a signed long, for every row of ``docs``.

    Null, empty and wordless texts give 0; null ids stay null; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    return _marked(docs, id_col, text_col, shingle).select("doc_id", "fp")


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, txt, fp``: with a hash of the text, by which its row is found again."""
    ddl = "doc_id long, txt long, fp long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_signed(found))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, ddl)


def references(pivots: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(seed).integers(0, 1 << 64, pivots, np.uint64, endpoint=False)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference: ``[reference, fingerprint]``."""
    return np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int8)


def _least(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest node it is connected to."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = _least(len(fps), a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def linked(fps: np.ndarray, bounds: np.ndarray, refs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Pairs of ``fps`` in one of the groups ``bounds[k]:bounds[k + 1]`` that are at most ``most`` bits apart.

    Also how many pairs met, how many the pivots discarded, and how many survivors the bit count refused.
    """
    table = distance_table(fps, refs)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    partners = ends - np.arange(len(fps)) - 1  # those behind it in its group
    upto = np.cumsum(partners)
    found_a, found_b, told = [], [], {"met": int(partners.sum()), "discarded": 0, "refused": 0}
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _STRIP, side="right")))
        own = partners[lo:hi]
        a = np.repeat(np.arange(lo, hi), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        met = len(a)
        for column in table:
            near = np.abs(column[a] - column[b]) <= most
            a, b = a[near], b[near]
        told["discarded"] += met - len(a)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= most
        told["refused"] += int((~near).sum())
        found_a.append(a[near])
        found_b.append(b[near])
        lo = hi
    return (np.concatenate(found_a), np.concatenate(found_b), told) if found_a else (np.zeros(0, int), np.zeros(0, int), told)


def _mixed(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    x = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + block
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def keyed(fps: np.ndarray, masks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Group key and equal bits of each fingerprint at each of its six places: ``[fingerprint, place]``.

    ``masks`` marks the bits that are equal in its present group; the others are cut into four blocks.
    """
    width = 16 >> level
    bits = np.unpackbits(~masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
    rank = np.cumsum(bits, axis=1) - 1
    blocks = np.zeros((4, len(fps)), np.uint64)
    for k in range(4):
        own = bits & (rank // width == k)
        blocks[k] = np.packbits(own, axis=1, bitorder="little").view(np.uint64)[:, 0]
    equal = np.stack([masks | blocks[a] | blocks[b] for a, b in _BLOCK_PAIRS], axis=1)
    # the mask is part of the key: groups that agree in different bits stay apart
    return _mixed(_mixed(equal, equal & fps[:, None]), np.uint64(level)), equal


def _forest_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a ``fps array<long>`` column."""
    refs = references()
    for batch in slices(batches, 512):
        lists = batch.column(0)
        fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fps):
            continue
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        a, b, _ = linked(fps, bounds, refs, most)
        names, node = np.unique(fps, return_inverse=True)
        x, y = _forest(names, node[a], node[b])
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=_EDGES)


def links(distinct: DataFrame, most: int = 2, group: int | None = None) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints ``fp`` at most ``most`` (0 to 2) bits apart to connect
    all that are connected. An empty table gives no links."""
    if not 0 <= most <= 2:
        raise ValueError("four blocks, two of which agree, cover distances 0 to 2")
    ddl = "k long, fp long, mask long"
    schema = arrow_schema(ddl)
    found: DataFrame | None = None
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(3):

        def deal(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 8192):
                fps, masks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
                if len(fps):
                    key, equal = keyed(fps, masks, level)
                    columns = [key.ravel(), np.repeat(fps, 6), equal.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], schema=schema)

        dealt = rows.mapInArrow(deal, ddl)
        if level:  # groups that were cut overlap
            dealt = dealt.distinct()
        dealt = staged(dealt, f"simhash-level-{level}")
        sizes = staged(dealt.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-sizes-{level}")
        met = staged(join_spread(dealt, sizes, "k", F.xxhash64("fp")), f"simhash-met-{level}")
        most_of = 256 if level == 2 else group or GROUP
        whole = met.where(F.col("n") <= most_of).groupBy("k").agg(F.collect_list("fp").alias("fps")).select("fps")
        near = whole.mapInArrow(lambda batches: _forest_of(batches, most), _EDGE_DDL)
        found = near if found is None else found.unionByName(near)
        rows = met.where(F.col("n") > most_of).select("fp", "mask")
        if rows.isEmpty():
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of the undirected ``a, b`` edges the smallest node it is connected to.

    Alternates the large-star and small-star steps until the edges are a star forest. Each step is written to the
    shared folder; only two numbers per round come to the driver.
    """
    current = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = staged(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``most`` differing bits, itself
    included. Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows come
    back as often as they came; rows without ``doc_id`` keep a null id and join components without naming them. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    named = _named(docs, id_col, text_col, shingle, most)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, most: int = 2) -> DataFrame:
    """``doc_id, txt, fp, comp, component_id``: with the component itself, as two may bear one name where ids clash."""
    marked = staged(_marked(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    stars = components(links(distinct, most))
    named = stars.join(distinct.withColumnRenamed("fp", "node"), "node").select("root", "node", "first")
    own = stars.select("root").distinct().join(distinct.select(F.col("fp").alias("root"), "first"), "root").select("root", F.col("root").alias("node"), "first")
    members = staged(named.unionByName(own), "members")
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = members.join(smallest, "root").select(F.col("node").alias("fp"), "root", "component_id")
    return marked.join(distinct, "fp").join(groups, "fp", "left").select("doc_id", "txt", "fp", F.coalesce("root", "fp").alias("comp"), F.coalesce("component_id", "first").alias("component_id"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component ``comp`` of ``found`` (``doc_id, txt, comp, component_id``): that of its
    smallest id, and of several texts or rows with this id the one with the smallest hash. Rows without an id all stay.

    Rows are told apart by id and text, so a text that is like no other stays even if its id is that of a copy. Joined
    are the rows that go or repeat, not those that stay: they are fewer, and where Spark finds them small enough to
    broadcast, no text is shuffled but those of repeated rows. Rows travel in one struct, so no name of theirs can clash.
    """
    rows = staged(found.where("doc_id is not null").groupBy("doc_id", "txt").agg(F.count("*").alias("n"), F.first("comp").alias("comp"), F.first("component_id").alias("component_id")), "near-duplicate-rows")
    named = rows.where("doc_id = component_id").groupBy("doc_id", "comp").agg(F.min("txt").alias("txt"), F.lit(True).alias("stays"))
    other = staged(rows.join(named, ["doc_id", "comp", "txt"], "left").where("n > 1 or stays is null").select(F.col("doc_id").alias("_id"), F.col("txt").alias("_txt"), "stays"), "near-duplicate-ids")
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_txt"))
    once = packed.join(other.select("_id", "_txt"), ["_id", "_txt"], "left_anti")
    repeated = packed.join(other.where("stays").select("_id", "_txt"), ["_id", "_txt"], "left_semi").groupBy("_id", "_txt").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row").unionByName(repeated.select("_row")).select("_row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, with all its columns: that of the smallest id.

    Of rows that repeat an id and a text one stays; an id with two texts is two documents; rows without an id all stay,
    as nothing names them. Null, empty and wordless texts are one group. An empty table gives an empty result.
    """
    return keep_first(docs, _named(docs, id_col, text_col), id_col, text_col)
