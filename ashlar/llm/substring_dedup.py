"""Repeated word windows by level-wise doubling.

A window of ``window`` words that occurs twice contains windows of half and of a quarter that length that occur twice.
So lengths double: 9, 18 and 35 words for windows of 35. Only windows that are repeated at one length are looked at,
extended, at the next, until no candidates survive or the asked length is reached.

*First length.* Among the 9-word windows of each run of 27, those with the least hash are anchors. Which these are
depends on the words alone, so every 35-word window and all its copies hold the same anchors; a fourteenth of all
windows is enough, and none is missed.

*Doubling.* A repeated anchor is extended to the right or, near the end of a 35-word window, to the left. A 35-word
window is a candidate if its first anchor's extension inside it is repeated, and its own words are hashed only then.

*Exchange.* Rows are dealt into groups of about ``GROUP_BYTES`` by their place in the input, so neither null nor repeated
ids crowd a group, and every level visits the same groups. A group sends the distinct hashes of its candidates; a hash
that two groups send is repeated, and the join that tells them so splits hot hashes (``common.join_spread``). What occurs
twice inside one group is known there. So a passage that a third of all documents share crosses the network once per
group, sums are formed before the shuffle, and the work is linear in the input. Texts are shuffled once, into a bucketed
table that every level reads.

Window hashes are 64 bits, so among n candidate windows about n*n/2**65 pairs are taken for equal by chance.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, join_spread, partitions, staged

WINDOW = 35
#: Bytes of text for each group of documents; a task holds one at a time.
GROUP_BYTES = 4 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20
_BYTES = np.random.default_rng(9).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_ODD = 0xD6E8FEB86659FD93


@functools.lru_cache(maxsize=2)
def _byte_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte multiplier and of its inverse."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        power = np.full(size, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of a byte string and a 64-bit hash of it; words longer than 64 bytes take XXH3."""
    every = np.frombuffer(data, np.uint8)
    starts, hashes, lo = [], [], 0
    while lo < len(every):
        hi = min(lo + _PIECE, len(every))
        while hi < len(every) and not (gap := _SPACE[every[hi : hi + 4096]]).any():
            hi += len(gap)
        if hi < len(every):
            hi += int(gap.argmax())
        raw = every[lo:hi]
        power, inverse = _byte_powers(max(_PIECE + 4096, 1 << (len(raw) - 1).bit_length()))
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = ~_SPACE[raw]
        change = np.diff(solid)
        begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
        size = end - begin
        found = _mix((total[end] - total[begin]) * inverse[begin] + size.astype(np.uint64) * _U(_MULTIPLIER))
        for k in np.flatnonzero(size > 64).tolist():
            found[k] = xxhash.xxh3_64_intdigest(data[lo + int(begin[k]) : lo + int(end[k])], 9)
        starts.append(begin + lo)
        hashes.append(found)
        lo = hi
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes; built by doubling, so it costs log(size) passes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    power = _powers(size + 1)
    done, out, rest, total = 0, None, words, 1
    # out covers `done` words from each place; rest covers `total`
    left = size
    while left:
        if left & 1:
            out = rest.copy() if out is None else out[: len(words) - done - total + 1] + power[done] * rest[done : done + len(words) - done - total + 1]
            done += total
        left >>= 1
        if left:
            rest = rest[: len(words) - 2 * total + 1] + power[total] * rest[total : len(words) - total + 1]
            total *= 2
    return _mix(out)


def _extreme(x: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """Minimum or maximum of each run of ``size``."""
    total = 1
    while total * 2 <= size:
        x = pick(x[:-total], x[total:])
        total *= 2
    return pick(x[: len(x) - (size - total)], x[size - total :]) if size > total else x


def lengths(window: int) -> tuple[int, int, int]:
    half = -(-window // 2)
    return -(-half // 2), half, window


class Group:
    """The word sequences of one group's documents, and the candidate windows of each level."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        self.first, self.half, self.window = lengths(window)
        self.texts = texts
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        begin, self.words = word_hashes(b" ".join(raw))
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        self.starts = np.searchsorted(begin, bounds)
        self.counts = np.diff(self.starts)
        self.end = np.repeat(self.starts[1:], self.counts)

    def _inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which of the windows that start at ``at`` lie in one document."""
        return (at >= 0) & (at + size <= len(self.words)) & (at + size <= self.end[np.minimum(at, len(self.end) - 1)]) if len(self.words) else np.zeros(len(at), bool)

    def anchors(self) -> None:
        """Places of the anchors, and each full window's first one."""
        run = self.window - self.first + 1
        self.tiny = np.maximum(rolling(self.words, self.first), _U(1))  # 0 stands for no window below
        if len(self.words) < self.window:
            self.places = self.full = self.owner = np.zeros(0, np.int64)
            return
        least = _extreme(self.tiny, run, np.minimum)
        full = np.arange(len(least))
        ok = self._inside(full, self.window)
        shown = np.where(ok, least, _U(0))
        around = np.concatenate((np.zeros(run - 1, np.uint64), shown, np.zeros(run - 1, np.uint64)))
        covers = _extreme(around, run, np.maximum)
        self.places = np.flatnonzero((covers == self.tiny) & (covers > 0))
        self.full = full[ok]
        mine = np.searchsorted(self.places, self.full)
        target = least[self.full]
        open_ = np.flatnonzero(self.tiny[self.places[np.minimum(mine, len(self.places) - 1)]] != target) if len(self.places) else np.zeros(0, int)
        while len(open_):
            mine[open_] += 1
            open_ = open_[self.tiny[self.places[mine[open_]]] != target[open_]]
        self.owner = mine

    def level(self, n: int, repeated: list[np.ndarray]) -> np.ndarray:
        """Hashes of the candidates of level ``n`` in a fixed order; ``repeated`` says for each earlier level's
        candidates whether they are."""
        if n == 0:
            self.anchors()
            return self.tiny[self.places]
        if n == 1:
            self.alive = np.flatnonzero(repeated[0])
            at = self.places[self.alive]
            self.sides = np.concatenate((at, at + self.first - self.half))
            self.side_ok = self._inside(self.sides, self.half)
            doubled = rolling(self.words, self.half)
            return doubled[self.sides[self.side_ok]]
        good = np.zeros(len(self.sides), bool)
        good[self.side_ok] = repeated[1]
        right, left = np.zeros(len(self.places), bool), np.zeros(len(self.places), bool)
        right[self.alive], left[self.alive] = good[: len(self.alive)], good[len(self.alive) :]
        if not len(self.full):
            self.candidates = self.full
            return np.zeros(0, np.uint64)
        fits = self.places[self.owner] - self.full + self.half <= self.window
        self.candidates = self.full[np.where(fits, right[self.owner], left[self.owner])]
        return rolling(self.words, self.window)[self.candidates]

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which words lie in a repeated full window."""
        step = np.zeros(len(self.words) + 1, np.int64)
        at = self.candidates[repeated]
        np.add.at(step, at, 1)
        np.add.at(step, at + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _replies(group: Group, levels: int, told: pa.Table) -> list[np.ndarray]:
    """For each level below ``levels``, which of its candidates are repeated; ``told`` names those other groups sent."""
    level, hashes = told.column("level").to_numpy(), told.column("hash").to_numpy().view(np.uint64)
    out: list[np.ndarray] = []
    for n in range(levels):
        distinct, inverse, counts = np.unique(group.level(n, out), return_inverse=True, return_counts=True)
        twice = (counts > 1) | np.isin(distinct, hashes[level == n])
        out.append(twice[inverse])
    return out


def _group(docs: pa.Table, window: int) -> tuple[pa.Table, Group]:
    # the same order at every visit; rows that agree in both columns are interchangeable
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return docs, Group(docs.column("text").to_pylist(), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that also starts somewhere else.

    ``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``, and the kept words joined by one space as
    ``kept`` if ``keep_text``. Words are runs of anything but ASCII white space; windows lie in one document and are
    judged on the input. Null and empty texts have no words; rows that repeat a document are occurrences of their own;
    null ids stay null. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if window < 4:
        raise ValueError("windows of at least 4 words can be doubled twice")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = max(partitions(spark), -(-size // GROUP_BYTES))
    # by place, not by id: the table is written once, so the place is decided once
    grouped = bucketed(own.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(spread)).cast("int")), "g", partitions(spark), "substring_groups")
    told_ddl = "g int, level int, hash long"
    sent_schema = arrow_schema(told_ddl)
    told = spark.createDataFrame([], told_ddl)

    def send(n: int):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return sent_schema.empty_table()
            _, group = _group(left, window)
            hashes = np.unique(group.level(n, _replies(group, n, right)))
            return pa.table([pa.array(np.full(len(hashes), key[0].as_py(), np.int32)), pa.array(np.full(len(hashes), n, np.int32)), pa.array(hashes.view(np.int64))], schema=sent_schema)

        return run

    for n in range(3):
        sent = staged(grouped.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(send(n), told_ddl), f"sent-{n}")
        again = staged(sent.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), f"again-{n}")
        found = join_spread(sent, again, "hash", F.xxhash64("g")).select("g", "level", "hash")
        told = told.unionByName(staged(found, f"told-{n}"))

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    schema = arrow_schema(ddl)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        table, group = _group(left, window)
        known = _replies(group, 3, right)
        gone = group.covered(known[2])
        rows = []
        for i, text in enumerate(group.texts):
            mine = gone[group.starts[i] : group.starts[i + 1]]
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            removed = int(mine.sum())
            if removed:
                words = [w for w, g in zip(words, mine.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            rows.append((len(mine), removed, hashlib.sha256(kept).hexdigest(), kept.decode())[: 3 + keep_text])
        return pa.table([table.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]], schema=schema)

    return grouped.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(finish, ddl)
