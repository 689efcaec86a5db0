"""Line deduplication by pairwise alignment.

Documents that share a passage are aligned by patience diff, and the aligned common blocks are deleted from the later
one (the larger id). Equal texts are one class throughout: the first document of a class takes part, each later copy is
one block from start to end.

*Passages.* Blocks of at least ``MIN_WORDS`` words go, so what pairs two documents is a run of one to ``MIN_WORDS``
lines that just reaches that many words, counted from its first line or from its last. Every line of a common block lies
in such a run, and the whole run is common. A line of ``MIN_WORDS`` words is a run of its own.

*Pairs.* Every holder of a run is paired with its first holder, however many there are: pairs stay linear in the lines,
and neither rare nor frequent runs are left out. More copies of a passage never lose fewer lines.

*Alignment.* What travels is not the documents but their shared runs, with their positions in both. Lines with one
position in both are anchors, the longest increasing run of anchors is kept, and the regions between are aligned in the
same way, in the end by an exact longest common subsequence. Matches without a gap in either document are a block.
What is left of the later document is aligned again with the whole earlier one, until no block comes out, so blocks that
were moved or repeated go as well, and the first holder does for all earlier ones. All is judged on the input, so the first document that has a passage always keeps it.

*Hot passages.* A run that a third of all documents hold is one entry per task before its shuffle, and the join that
tells its holders who the first one is splits it (``common.join_spread``). Runs are found by one 64-bit hash of their
lines, and a pair is only aligned on lines whose other 64-bit hash agrees too.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, join_spread, slices, staged

MIN_WORDS = 5
LCS_BITS = 1 << 27
#: Contracts' white space, as in ``WORD``.
_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = (1 << 63) - 1
#: A line with a word: two independent hashes and its number of words.
_LINE = np.dtype([("h", "<u8"), ("c", "<u8"), ("w", "<u4")])
#: What a run tells about each of its lines.
_OF_RUN = np.dtype([("c", "<u8"), ("w", "<u4")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``(x, y)``, sorted by ``x``, in which ``y`` increases."""
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(ends, y)
        if k:
            back[i] = last[k - 1]
        if k == len(ends):
            ends.append(y)
            last.append(i)
        else:
            ends[k], last[k] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a`` a number whose zero bits below ``j`` count the LCS with the first ``j`` lines of ``b``."""
    held: dict[int, int] = {}
    for k, line in enumerate(b):
        held[line] = held.get(line, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        same = row & held.get(line, 0)
        row = ((row + same) | (row - same)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS of ``a`` with each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, exact; halves ``a`` where the rows would take over ``LCS_BITS``."""
    common = set(a) & set(b)
    at_a, at_b = ([k for k, line in enumerate(side) if line in common] for side in (a, b))
    out: list[tuple[int, int]] = []
    parts = [(0, len(at_a), 0, len(at_b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = [a[k] for k in at_a[a0:a1]], [b[k] for k in at_b[b0:b1]]
        if len(x) > 1 and len(x) * len(y) > LCS_BITS:
            mid = len(x) // 2
            cut = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
            parts += [(a0, a0 + mid, b0, b0 + cut), (a0 + mid, a1, b0 + cut, b1)]
            continue
        rows = list(_rows(x, y))
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                continue
            j -= 1
            out.append((at_a[a0 + i], at_b[b0 + j]))
    return sorted(out)


def patience(later: dict[int, int], earlier: dict[int, int]) -> list[tuple[int, int]]:
    """Matches of two sparse line sequences ``{position: line}``, increasing on both sides."""
    matches: list[tuple[int, int]] = []
    xs, ys = sorted(later), sorted(earlier)
    regions = [(0, len(xs), 0, len(ys))]
    while regions:
        x0, x1, y0, y1 = regions.pop()
        if x0 >= x1 or y0 >= y1:
            continue
        once: dict[int, list[int]] = {}
        for side, places, lines, lo, hi in ((0, xs, later, x0, x1), (1, ys, earlier, y0, y1)):
            for k in range(lo, hi):
                entry = once.setdefault(lines[places[k]], [-1, -1])
                entry[side] = k if entry[side] == -1 else -2
        anchors = _increasing(sorted((a, b) for a, b in once.values() if a >= 0 and b >= 0))
        if not anchors:
            # no line is unique here: match equal lines from both ends inwards, and what is left by an exact LCS
            while x0 < x1 and y0 < y1 and later[xs[x0]] == earlier[ys[y0]]:
                matches.append((xs[x0], ys[y0]))
                x0, y0 = x0 + 1, y0 + 1
            while x0 < x1 and y0 < y1 and later[xs[x1 - 1]] == earlier[ys[y1 - 1]]:
                x1, y1 = x1 - 1, y1 - 1
                matches.append((xs[x1], ys[y1]))
            inner = longest_common([later[p] for p in xs[x0:x1]], [earlier[p] for p in ys[y0:y1]])
            matches += [(xs[x0 + a], ys[y0 + b]) for a, b in inner]
            continue
        px, py = x0, y0
        for a, b in anchors:
            matches.append((xs[a], ys[b]))
            regions.append((px, a, py, b))
            px, py = a + 1, b + 1
        regions.append((px, x1, py, y1))
    return sorted(matches)


def common_blocks(later: dict[int, int], earlier: dict[int, int], words: dict[int, int], least: int = MIN_WORDS) -> list[int]:
    """Positions in ``later`` of the aligned blocks with at least ``least`` words.

    A block of the earlier document serves every repeat of it in the later one. What no block has taken there is aligned
    again; where that gives only blocks of fewer words, without those.
    """
    left, out = dict(later), []
    while matches := patience(left, earlier):
        cuts = [k for k in range(1, len(matches)) if matches[k] != (matches[k - 1][0] + 1, matches[k - 1][1] + 1)]
        blocks = [matches[s:e] for s, e in zip([0, *cuts], [*cuts, len(matches)], strict=True)]
        whole = [b for b in blocks if sum(words[p] for p, _ in b) >= least]
        for block in whole or blocks:
            for p, _ in block:
                del left[p]
        out += [p for block in whole for p, _ in block]
        # what repeats a block goes with it, so that each round meets a block of its own
        places: dict[int, list[int]] = {}
        for p, line in left.items():
            places.setdefault(line, []).append(p)
        for lines in {tuple(later[p] for p, _ in block) for block in whole}:
            for start in places.get(lines[0], ()):
                if all(left.get(start + k) == line for k, line in enumerate(lines)):
                    for k in range(len(lines)):
                        del left[start + k]
                        out.append(start + k)
    return sorted(out)


def text_lines(text: str | None) -> np.ndarray:
    """The lines with a word of a text, without the white space around them."""
    import xxhash

    raw = [x for x in (y.strip(_SPACE) for y in (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if x]
    out = np.empty(len(raw), _LINE)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, 5) for x in raw]), "<u8").reshape(-1, 2)
    out["h"], out["c"] = digests[:, 0], digests[:, 1]
    out["w"] = [len(x.split()) for x in raw]
    return out


def line_runs(words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each shortest run of at least ``least`` words from a line on or up to one."""
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    n = len(words)
    upto = np.searchsorted(total, total[:-1] + least)
    begin = np.flatnonzero(upto <= n)
    end = np.flatnonzero(total[1:] >= least)
    starts = np.concatenate((begin, np.searchsorted(total, total[end + 1] - least, side="right") - 1))
    sizes = np.concatenate((upto[begin], end + 1)) - starts
    both = np.unique(starts * (least + 1) + sizes)
    return both // (least + 1), both % (least + 1)


def _run_keys(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    key = sizes.astype(np.uint64)
    for k in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > k)
        x = (key[more] ^ (key[more] >> np.uint64(29))) * _ODD + h[starts[more] + k]
        key[more] = x ^ (x >> np.uint64(32))
    return key.view(np.int64)


def _class_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _order(id_: Column) -> Column:
    return F.coalesce(id_, F.lit(_NO_ID)).cast("long")


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive ``counts`` of ``values`` as byte strings."""
    bounds = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


_RUN_DDL = "key long, first long, class binary, lines binary, at binary"
_RUN_SCHEMA = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("class", pa.binary()), ("lines", pa.binary()), ("at", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each class: ``_RUN_DDL`` from ``class, first, lines``."""
    for batch in slices(batches, 64):
        lines = [np.frombuffer(x, _LINE) for x in batch.column(2).to_pylist()]
        base = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
        flat = np.concatenate(lines)
        owner, starts, sizes = [], [], []
        for k, own in enumerate(lines):
            at, size = line_runs(own["w"])
            owner.append(np.full(len(at), k))
            starts.append(at + base[k])
            sizes.append(size)
        doc, start, size = np.concatenate(owner), np.concatenate(starts), np.concatenate(sizes)
        if not len(doc):
            continue
        key = _run_keys(flat["h"], start, size)
        order = np.lexsort((start, key, doc))
        doc, start, size, key = doc[order], start[order], size[order], key[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        shown = np.empty(int(size[new].sum()), _OF_RUN)
        own = flat[_spans(start[new], size[new])]
        shown["c"], shown["w"] = own["c"], own["w"]
        rows = pa.array(doc[new])
        columns = [pa.array(key[new]), batch.column(1).take(rows), batch.column(0).take(rows), _binary(shown, size[new]), _binary((start - base[doc]).astype("<i4"), np.diff(np.append(new, len(doc))))]
        yield pa.RecordBatch.from_arrays(columns, schema=_RUN_SCHEMA)


def _aligned(hits: list[dict]) -> list[int]:
    """The lines that go from one document, whose shared runs with all its partners are given."""
    pairs: dict[tuple, tuple[dict, dict, dict]] = {}
    for hit in hits:
        head = hit["head"]
        if hit["lines"] != head["lines"]:
            continue  # the runs only share a hash
        later, earlier, words = pairs.setdefault((head["first"], head["class"]), ({}, {}, {}))
        lines = np.frombuffer(hit["lines"], _OF_RUN)
        for k, (c, w) in enumerate(zip(lines["c"].tolist(), lines["w"].tolist(), strict=True)):
            for p in np.frombuffer(hit["at"], "<i4").tolist():
                later[p + k], words[p + k] = c, w
            for p in np.frombuffer(head["at"], "<i4").tolist():
                earlier[p + k] = c
    out: set[int] = set()
    for later, earlier, words in pairs.values():
        out.update(common_blocks(later, earlier, words))
    return sorted(out)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``class, n, first, words, gone`` for the classes of equal texts that have copies or lose lines: number of
    documents, first id, words, and the lines with a word, counted from 0, to delete from the first document."""
    ddl = "class binary, id long, words long, lines binary"
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_lines(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(x["w"].sum()) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], schema=schema)

    rows = docs.select(_class_of(F.col(text_col)).alias("class"), _order(F.col(id_col)).alias("id"), F.col(text_col)).mapInArrow(read, ddl)
    classes = staged(rows.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("words").alias("words"), F.first("lines").alias("lines")), "line-classes")
    runs = classes.select("class", "first", "lines").mapInArrow(_runs, _RUN_DDL)
    doc = F.struct("first", "class", "lines", "at")
    heads = staged(runs.groupBy("key").agg(F.count("*").alias("n"), F.min(doc).alias("head")).where("n > 1"), "line-heads")
    met = join_spread(runs, heads, "key", F.xxhash64("class")).where(F.col("class") != F.col("head.class"))
    hits = met.groupBy("class").agg(F.collect_list(F.struct("lines", "at", "head")).alias("hits"))
    gone_ddl = "class binary, gone array<int>"
    gone_schema = arrow_schema(gone_ddl)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            gone = [_aligned(hits.as_py()) for hits in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, gone_schema.types[1])], schema=gone_schema)

    gone = hits.mapInArrow(align, gone_ddl).where(F.size("gone") > 0)
    verdicts = classes.select("class", "n", "first", "words").join(gone, "class", "left").where("n > 1 or gone is not null")
    return staged(verdicts, "line-verdicts")


def drop_lines(text: str, gone: set[int] | None) -> tuple[str, int]:
    """The text without the non-blank lines at ``gone`` (None: without any of at least one), and how many went."""
    if gone is not None and not gone:
        return text, 0
    kept, at, removed = [], -1, 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            at += 1
            if gone is None or at in gone:
                removed += 1
                continue
        kept.append(line)
    return "\n".join(kept) if removed < at + 1 else "", removed


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (the row of docs), ``_whole`` and ``_gone`` for every row of ``docs``."""
    verdicts = removals(docs, id_col, text_col)
    packed = docs.select(F.struct("*").alias("_row"), _order(F.col(id_col)).alias("_id"), _class_of(F.col(text_col)).alias("class"))
    # copies of one text differ by id or not at all, so their place in the scan spreads them
    met = join_spread(packed, verdicts, "class", F.xxhash64(F.monotonically_increasing_id()), "left")
    whole = (F.col("_id") > F.col("first")) & (F.col("words") >= MIN_WORDS)
    return met.select("_row", F.coalesce(whole, F.lit(False)).alias("_whole"), F.when(F.col("_id") == F.col("first"), F.col("gone")).alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with aligned common blocks deleted from the later documents; all rows and columns stay.

    A copy of an earlier text of at least ``MIN_WORDS`` words is left empty. Rows that repeat one id and text are the
    same document and keep their text. Null texts stay null; null ids come after all others. Blank lines stay, unless
    no line with a word is left. An empty table gives an empty result.
    """
    decided, names = _decided(docs, id_col, text_col), docs.columns
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = batch.column(0).flatten()
            texts = [
                None if t is None else drop_lines(t, None if whole else set(gone or ()))[0]
                for t, whole, gone in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return decided.mapInArrow(run, docs.schema)


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row: lines with a word, those deleted, and the digest of
    the text that is left (null: empty).

    Null and empty texts have no lines; equal rows give equal results and come back as often as they came; null ids
    stay null and count as later than all others; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    ddl = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for t, whole, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, removed = drop_lines(t or "", None if whole else set(gone or ()))
                total = sum(1 for x in (t or "").encode("utf-8", "surrogatepass").split(b"\n") if x.split())
                rows.append((total, removed, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _decided(own, "doc_id", "text").select("_row.doc_id", "_row.text", "_whole", "_gone").mapInArrow(run, ddl)
