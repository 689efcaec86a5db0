"""Near-duplicate documents by the Jaccard similarity of their word shingles: SimHash first, then an exact join.

A text is the set of its 64-bit shingle hashes; equal sets are one node, so copies cost nothing. Links are decided by
the whole sets. Candidates come in three rounds.

*First round*, linear. Operator 10 links the nodes' 64-bit SimHash fingerprints by its pivot distances; besides, each
node is compared with two more, those it most often meets (see below) as the smallest of its class of sizes and as the
one before it by size.

*Second round*, linear. Wherever several components of the first meet, each is compared with the one nearest to it by
the parities below. So a large group of near copies is one component, or nearly, before all pairs are formed.

*Third round*, which no similar pair escapes. In any fixed order of all shingles, two sets of similarity ``s`` or more
share one of their first ``n - ceil(s * n) + 1`` members each, so only sets that meet at such a shingle can be linked.
Those of one component of the rounds before need no look. For the others the parities of the parts of two sets differ in
at most as many bits as the sets differ in members. Parities of 512 parts refuse most pairs of short texts where they
meet, before they are rows; those of as many parts as a set has members refuse most other pairs before whole sets
travel. The order is by hash, with the most crowded shingles last; which those are changes the cost and never the result.

*Where sets meet.* The (shingle, size, node) entries are sorted by ranges over all tasks and cut into blocks of at most
``_BLOCK`` sets, so no shingle is one row or one task, however many sets meet at it. A shingle of several blocks has its
blocks' first members compared along the chain of blocks in the first round; in the third, spans of ``_SPAN`` blocks meet
the spans whose sizes allow a similarity, each pair of spans in a task of its own.

Sets are compared by 40 bits of each hash: of two sets of 1000 shingles about one in a million counts one too many.

SimHash alone cannot do this: at similarity 0.8 about 10 of 64 bits differ, where no pivot table discards anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_schema, partitions, slices, staged
from .simhash import components, keep_first

SHINGLE = 5
#: Least similarity of a link, in tenths.
TENTHS = 8
#: A shingle that about this many sets meet at goes to the end of the order; at most ``_LAST`` do. They are found on
#: one of ``SAMPLE`` texts, which bears on the cost only.
CROWDED = 256
SAMPLE = 16
_LAST = 200_000
#: Sets of one shingle in a row, and blocks of one shingle that meet others together.
_BLOCK = 1024
_SPAN = 16
_AHEAD = 64
_PAIRS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_HEAD = pa.schema([*_PAIR, ("next", pa.bool_())])


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles of lower-cased words; one of all words where they are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = (total ^ (total >> np.uint64(29))) * _ODD + own[k : len(words) - width + 1 + k]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(32)))


def _node(hashes: np.ndarray) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
    return value - (value >> 63 << 64)


def _bits(hashes: np.ndarray) -> bytes:
    """Parities of the counts of a set's members in parts: a power of two of parts, 512 or as many as members."""
    parts = max(512, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 512
    dealt = (hashes >> np.uint64(7)) & np.uint64(parts - 1)
    return np.packbits(np.bincount(dealt.astype(np.int64), minlength=parts) & 1).tobytes()


def _folded(bits: bytes, size: int) -> bytes:
    """The parities in ``8 * size`` parts: of two parts that become one, the parities add up."""
    found = np.frombuffer(bits, np.uint8)
    while len(found) > size:
        found = found[: len(found) // 2] ^ found[len(found) // 2 :]
    return found.tobytes()


def _print(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed long."""
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _prefix(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The members that a similar set shares at least one of."""
    size = len(hashes)
    need = size + (-TENTHS * size // 10) + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        behind = last[at] == hashes
        hashes = np.concatenate((hashes[~behind], hashes[behind]))
    return hashes[:need]


_SKETCH_DDL = "doc_id long, txt long, node long, n int, parities binary, bits binary, fp long, prefix array<long>"


def _sketched(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """Everything but the set itself of each row of ``doc_id, txt, text``, in one reading of the texts."""
    schema = arrow_schema(_SKETCH_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            bits = [_bits(x) for x in sets]
            prefixes = [_prefix(x, last).view(np.int64) if len(x) else x.view(np.int64) for x in sets]
            found = [[_node(x) for x in sets], [len(x) for x in sets], [_folded(x, 64) for x in bits], bits, [_print(x) for x in sets], prefixes]
            columns = [pa.array(c, t) for c, t in zip(found, schema.types[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    return docs.mapInArrow(run, _SKETCH_DDL)


_MET_DDL = "tok long, blk long, more boolean, met array<struct<n: int, node: long>>"


def _cut(batches: Iterator[pa.RecordBatch], block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``block`` entries of one shingle, from a partition of sorted ``tok, n, node``.

    ``more`` marks those whose shingle may have other blocks, here or in the partitions beside. Numbers of blocks ascend
    in the order of all entries. What only one set has is dropped.
    """
    met = schema.field("met").type
    number = TaskContext.get().partitionId() << 40
    held, others = np.zeros((3, 0), np.int64), True
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate((held, [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]), axis=1)
        tok = held[0]
        if not len(tok):
            continue
        start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        many = np.diff(np.append(start, len(tok)))
        pieces = -(-many // block)
        run = np.repeat(np.arange(len(start)), pieces)
        within = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = start[run] + within * block
        size = np.minimum(block, (start + many)[run] - lo)
        more = pieces[run] > 1
        more[run == 0] |= others
        stop = len(lo)
        if batch is None:
            more[run == run[-1]] = True
        else:  # the last one waits for what follows
            stop -= 1
            others = bool(within[-1] > 0 or (others and len(start) == 1))
        keep = np.flatnonzero((size[:stop] > 1) | more[:stop])
        if len(keep):
            ends = np.cumsum(size[keep])
            places = np.repeat(lo[keep] - ends + size[keep], size[keep]) + np.arange(ends[-1])
            members = pa.StructArray.from_arrays([pa.array(held[1, places].astype(np.int32)), pa.array(held[2, places])], fields=list(met.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), members, type=met)
            yield pa.RecordBatch.from_arrays([pa.array(tok[lo[keep]]), pa.array(number + keep), pa.array(more[keep]), lists], schema=schema)
        if batch is not None:
            number += stop
            held = held[:, lo[stop] :]


def _met(sketches: DataFrame) -> DataFrame:
    """``tok, blk, more, met``: the ``n, node`` of the sets that meet at each shingle of a prefix, in blocks by size."""
    block, schema = _BLOCK, arrow_schema(_MET_DDL)
    entries = sketches.select(F.explode("prefix").alias("tok"), "n", "node")
    ordered = entries.repartitionByRange(partitions(sketches.sparkSession), "tok", "n", "node").sortWithinPartitions("tok", "n", "node")
    return ordered.mapInArrow(lambda batches: _cut(batches, block, schema), _MET_DDL)


def _chain(met: DataFrame) -> DataFrame:
    """``a, b``: the first members of successive blocks of one shingle; one row a block is all that is gathered."""
    firsts = met.where("more").select("tok", "blk", F.col("met")[0].alias("m"))
    pairs = firsts.select(F.lag("m").over(Window.partitionBy("tok").orderBy("blk")).alias("l"), "m")
    return pairs.where(F.col("m.n") * TENTHS <= F.col("l.n") * 10).select(F.col("l.node").alias("a"), F.col("m.node").alias("b"))


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``a, b`` of those rows of ``a, b, m, n, x, y`` whose sizes and parities allow the similarity."""
    for batch in slices(batches):
        kept = []
        for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            size = min(len(x), len(y))
            one, two = (int.from_bytes(_folded(z, size), "little") for z in (x, y))
            kept.append((one ^ two).bit_count() * (10 + TENTHS) <= (m + n) * (10 - TENTHS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(kept, pa.bool_()))


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    one, two = (sketches.select(F.col("node").alias(k), F.col("n").alias(size), F.col("bits").alias(bits)) for k, size, bits in (("a", "m", "x"), ("b", "n", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_may_be_similar, "a long, b long")


def _packed(hashes: np.ndarray) -> bytes:
    """The upper five bytes of each hash: what a pair needs to count what it shares."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def _to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``met``: each set with the first one of its class of sizes, and with the one before it; ``b`` is the set."""
    for batch in slices(batches, 1024):
        lists = batch.column(0)
        many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, node = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        own = np.repeat(np.arange(len(many)), many)
        order = np.lexsort((node, n, own))
        n, node = n[order], node[order]
        ends = np.searchsorted(own << 40 | n, own << 40 | n * 10 // TENTHS, side="right")
        stop = np.cumsum(many)
        at, first = stop - many, np.zeros(len(n), bool)
        while len(at):
            first[at] = True
            more = ends[at] < stop
            at, stop = ends[at][more], stop[more]
        head = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
        after = np.flatnonzero(np.arange(1, len(n)) < ends[:-1]) + 1
        for before, of, is_next in ((head[~first], np.flatnonzero(~first), False), (after - 1, after, True)):
            yield pa.RecordBatch.from_arrays([pa.array(node[before]), pa.array(node[of]), pa.array(np.full(len(of), is_next))], schema=_HEAD)


def _members(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """``n, node, comp, bits`` of the members of all lists, each list by size, and which list each is in."""
    many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    n, node, comp = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    bits = np.frombuffer(b"".join(flat.field(3).to_pylist()), np.uint64).reshape(-1, 8)
    own = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((node, n, own))
    return n[order], node[order], comp[order], bits[order], own


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``met``: for each component in a list, its pair with another one whose parities differ least.

    Each set is held against the ``_AHEAD`` that follow it by size, so the work is linear in the list.
    """
    for batch in slices(batches, 256):
        n, node, comp, bits, own = _members(batch.column(0))
        ends = np.searchsorted(own << 40 | n, own << 40 | n * 10 // TENTHS, side="right")
        least, partner = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
        for ahead in range(1, min(_AHEAD, len(n) - 1) + 1):
            a = np.flatnonzero((np.arange(ahead, len(n)) < ends[:-ahead]) & (comp[ahead:] != comp[:-ahead]))
            differ = np.bitwise_count(bits[a] ^ bits[a + ahead]).sum(1, dtype=np.int64)
            may = differ * (10 + TENTHS) <= (n[a] + n[a + ahead]) * (10 - TENTHS)
            a, differ = a[may], differ[may]
            for of, other in ((a, a + ahead), (a + ahead, a)):
                better = differ < least[of]
                least[of[better]], partner[of[better]] = differ[better], other[better]
        has = np.flatnonzero(least < np.iinfo(np.int64).max)
        has = has[np.lexsort((least[has], comp[has], own[has]))]
        if len(has):
            new = np.ones(len(has), bool)
            new[1:] = (comp[has][1:] != comp[has][:-1]) | (own[has][1:] != own[has][:-1])
            a, b = node[has[new]], node[partner[has[new]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _unlike(n: np.ndarray, node: np.ndarray, comp: np.ndarray, bits: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of each set and those at ``begin`` to ``ends`` that are of another component and may be similar."""
    partners = np.maximum(ends - begin, 0)
    upto = np.cumsum(partners)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, side="right")))
        ahead = partners[lo:hi]
        a = np.repeat(np.arange(lo, hi), ahead)
        b = np.repeat(begin[lo:hi], ahead) + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        may = differ * (10 + TENTHS) <= (n[a] + n[b]) * (10 - TENTHS)
        a, b = node[a[may]], node[b[may]]
        if len(a):
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], schema=_PAIR)
        lo = hi


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``met``: the pairs of different components within each list that may be similar."""
    for batch in slices(batches, 64):
        n, node, comp, bits, own = _members(batch.column(0))
        ends = np.searchsorted(own << 40 | n, own << 40 | n * 10 // TENTHS, side="right")
        yield from _unlike(n, node, comp, bits, np.arange(len(n)) + 1, ends)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ``later, met`` of two spans of blocks, or of one: the pairs across them (within it) that may be similar."""
    earlier, later = [], []
    for batch in batches:
        flags, lists = batch.column(batch.schema.get_field_index("later")).to_pylist(), batch.column(batch.schema.get_field_index("met"))
        for k, is_later in enumerate(flags):
            (later if is_later else earlier).append(lists.slice(k, 1))
    sides = [[np.concatenate(x) for x in zip(*(_members(lists)[:4] for lists in side), strict=True)] for side in (earlier, later) if side]
    for k, side in enumerate(sides):  # all of the earlier span come before those of the later one
        order = np.lexsort((side[1], side[0]))
        sides[k] = [x[order] for x in side]
    n, node, comp, bits = (np.concatenate(x) for x in zip(*sides, strict=True))
    begin, ends = np.arange(len(n)) + 1, np.searchsorted(n, n * 10 // TENTHS, side="right")
    if later:
        many = len(sides[0][0])
        begin = np.full(len(n), many)
        ends[many:] = many
    yield from _unlike(n, node, comp, bits, begin, ends)


def _spans(blocks: DataFrame) -> DataFrame:
    """``a, b``: what ``_between`` finds among the blocks of each shingle that has several, span against span."""
    numbered = blocks.select("tok", "blk", F.array_min("met.n").alias("lo"), F.array_max("met.n").alias("hi"), "least", "most").withColumn("at", F.floor((F.row_number().over(Window.partitionBy("tok").orderBy("blk")) - 1) / _SPAN))
    spans = numbered.groupBy("tok", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"))
    one, two = spans.alias("one"), spans.alias("two")
    meet = (F.col("one.tok") == F.col("two.tok")) & (F.col("one.at") <= F.col("two.at")) & (F.col("two.lo") * TENTHS <= F.col("one.hi") * 10)
    apart = F.least("one.least", "two.least") < F.greatest("one.most", "two.most")
    pairs = one.join(two, meet & apart).select("one.tok", F.col("one.at").alias("g"), F.col("two.at").alias("h"))
    sent = pairs.select("tok", "g", "h", F.explode(F.array_distinct(F.array("g", "h"))).alias("at")).join(numbered.select("tok", "at", "blk"), ["tok", "at"])
    sent = sent.select("tok", "g", "h", (F.col("at") > F.col("g")).alias("later"), "blk").join(blocks.select("blk", "met"), "blk")
    return sent.groupBy("tok", "g", "h").applyInArrow(_between, "a long, b long")


def _similar(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the ``a, b`` pairs of nodes whose whole sets are similar enough. Pass stored ``pairs``.

    Only the texts of these nodes are read as sets again, each once: one text a node, found by its hash.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = staged(sketches.select("node", "txt").join(nodes, "node", "left_semi").select("txt").distinct(), "shingle-wanted")
    texts = docs.select("txt", "text").join(wanted, "txt", "left_semi").groupBy("txt").agg(F.first("text").alias("text")).select("text")
    ddl = "node long, hashes binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([_packed(x) for x in found], pa.binary())], schema=schema)

    sets = staged(texts.mapInArrow(run, ddl).dropDuplicates(["node"]), "shingle-sets")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _unpacked(one), _unpacked(two)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * 10 >= TENTHS * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(near, pa.bool_()))

    # a head may be in very many pairs: both sides come straight from a shuffle, so Spark splits it
    one, two = (sets.select(F.col("node").alias(side), F.col("hashes").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")


def _crowded(docs: DataFrame) -> np.ndarray:
    """Shingles that very many sets meet at, ascending; at most ``_LAST``."""
    tried = _sketched(docs.where(F.pmod("txt", F.lit(SAMPLE)) == 0).dropDuplicates(["txt"]), np.zeros(0, np.uint64))
    often = tried.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > max(1, CROWDED // SAMPLE))
    found = often.orderBy(F.desc("n"), "tok").limit(_LAST).select("tok").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _apart(entries: DataFrame) -> DataFrame:
    """``tok, blk, more, met, least, most``: the blocks at which more than one component meets, or may with others'."""
    lists = entries.groupBy("tok", "blk", "more").agg(F.collect_list(F.struct("n", "node", "comp", "parities")).alias("met"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    return lists.where("more or least < most")


def links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a, b``: enough links between nodes to connect all that are connected.

    ``docs`` has ``txt, text`` and ``sketches`` the sketch of each node.
    """
    prints = staged(sketches.groupBy("fp").agg(F.min("node").alias("b")), "shingle-prints")
    same = sketches.join(prints, "fp").where("node != b").select(F.col("node").alias("a"), "b")
    by_print = staged(simhash.links(prints.select("fp")), "shingle-simhash")
    one, two = prints.select(F.col("fp").alias("a"), F.col("b").alias("x")), prints.select(F.col("fp").alias("b"), F.col("b").alias("y"))
    close = by_print.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)

    met = staged(_met(sketches), "shingle-met")
    heads = met.select("met").mapInArrow(_to_heads, "a long, b long, next boolean").groupBy("a", "b", "next").agg(F.count("*").alias("times"))
    best = heads.groupBy("b", "next").agg(F.max(F.struct("times", "a")).alias("h")).select(F.col("h.a").alias("a"), "b")
    likely = close.unionByName(best).unionByName(_chain(met)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = staged(_possible(likely, sketches), "shingle-first")
    near = staged(_similar(docs, sketches, first), "shingle-near")

    known = sketches.join(components(near), "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "parities")
    entries = met.select("tok", "blk", "more", F.explode("met").alias("m")).select("tok", "blk", "more", "m.n", "m.node")
    again = staged(_apart(entries.join(known, "node")), "shingle-again")

    close = again.select("met").mapInArrow(_nearest, "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    second = staged(_possible(close, sketches), "shingle-second")
    near = staged(near.unionByName(_similar(docs, sketches, second)), "shingle-nearer")

    entries = again.select("tok", "blk", "more", F.explode("met").alias("m")).select("tok", "blk", "more", "m.n", "m.node", "m.comp", "m.parities")
    known = components(near)
    again = staged(_apart(entries.join(known, "node", "left").withColumn("comp", F.coalesce("root", "comp"))), "shingle-last")
    found = again.where("not more").select("met").mapInArrow(_across, "a long, b long").unionByName(_spans(again.where("more")))
    rest = found.distinct().join(first.unionByName(second), ["a", "b"], "left_anti")
    return near.unionByName(_similar(docs, sketches, staged(_possible(rest, sketches), "shingle-rest")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row: the smallest id reachable over links of similarity 0.8 or more.

    Null, empty and wordless texts are one node, which is like no other; rows without an id join components without
    naming them; repeated rows come back repeated; an empty table gives an empty result; other columns are ignored.
    """
    return _named(docs, id_col, text_col).select("doc_id", "component_id")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, txt, comp, component_id``: with a hash of the text and the component itself."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    marked = staged(_sketched(texts, _crowded(texts)), "shingle-nodes")
    distinct = staged(marked.groupBy("node").agg(F.min("doc_id").alias("first")), "shingle-distinct")
    sketches = staged(marked.drop("doc_id").dropDuplicates(["node"]), "shingle-sketches")
    stars = staged(components(links(texts, sketches)), "shingle-stars")
    both = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    smallest = both.join(distinct, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    groups = both.join(smallest, "root").select("node", "root", "component_id")
    return marked.select("doc_id", "txt", "node").join(distinct, "node").join(groups, "node", "left").select("doc_id", "txt", F.coalesce("root", "node").alias("comp"), F.coalesce("component_id", "first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest id, with all columns. An id with two texts is two
    documents, of equal rows one stays, rows without an id all stay. An empty table gives an empty result."""
    return keep_first(docs, _named(docs, id_col, text_col), id_col, text_col)
