"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased words, hashed to ``2 ** BITS`` buckets. The machine scores
``b + sum(w_i) + sum over pairs of <v_i, v_j>``, so besides additive weights it learns that two terms together mean
more than each alone. Terms are screened, and lasso on ``w`` and group lasso on the rows of ``v`` leave nothing of terms
that don't matter, which keeps long documents of many rare words quiet.

The machine is fitted on the driver from at most ``most`` labelled documents (default ``TRAIN_ROWS``), those with the
smallest seeded hash of their id; it is the same however large the corpus is. Scoring runs on whole texts in Arrow
tasks and moves no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

BITS = 18
TRAIN_ROWS = 12_000
FACTORS = 4
_TERM = re.compile(r"[^\W_]+")


class _Buckets(dict):
    """Bucket of each term, remembered for terms seen lately."""

    def __missing__(self, term: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        return found


def terms(text: str | None, buckets: _Buckets) -> np.ndarray:
    """Distinct buckets of a text's words."""
    words = set(_TERM.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)))


@dataclass
class Machine:
    bias: float
    rows: np.ndarray  # buckets with a weight or a factor
    w: np.ndarray
    v: np.ndarray

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        w, v = np.zeros(1 << BITS, np.float64), np.zeros((1 << BITS, self.v.shape[1]), np.float64)
        w[self.rows], v[self.rows] = self.w, self.v
        return w, v


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``at[:-1]``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def raw_scores(bias: float, w: np.ndarray, v: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Log-odds of each document, which is an array of buckets; a thousand documents at a time."""
    if len(docs) > 1000:
        return np.concatenate([raw_scores(bias, w, v, docs[lo : lo + 1000]) for lo in range(0, len(docs), 1000)])
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    factors = v[flat]
    both = _sums(factors, at) ** 2 - _sums(factors**2, at)
    return bias + _sums(w[flat], at) + both.sum(1) / 2


def _descend(docs: list[np.ndarray], labels: np.ndarray, width: int, bias: float, epochs: int, rate: float, l1: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Proximal AdaGrad on the logistic loss: lasso on ``w``, group lasso on the rows of ``v``."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(width), rng.normal(0, 0.01, (width, FACTORS))
    gw, gv, gb = np.full(width, 1e-3), np.full(width, 1e-3), 1e-3
    for _ in range(max(epochs, -(-360_000 // len(docs)))):  # few documents are seen more often
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 128):
            some = order[lo : lo + 128]
            rows = [docs[k] for k in some]
            at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            flat = np.concatenate(rows)
            factors = v[flat]
            total = _sums(factors, at)
            z = bias + _sums(w[flat], at) + ((total**2 - _sums(factors**2, at)).sum(1)) / 2
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
            each = np.repeat(error, np.diff(at)) / len(some)
            pull = np.repeat(total, np.diff(at), axis=0) - factors
            dw = np.bincount(flat, each, width)
            dv = np.stack([np.bincount(flat, each * pull[:, f], width) for f in range(FACTORS)], 1)
            gw += dw**2
            gv += (dv**2).mean(1)
            step = rate / np.sqrt(gw)
            w -= step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            step = rate / np.sqrt(gv)[:, None]
            v -= step * dv
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v *= np.maximum(1 - step * l1 / 10 / np.maximum(norm, 1e-12), 0)
            gb += error.mean() ** 2
            bias -= rate / np.sqrt(gb) * error.mean()
    return bias, w, v


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.5, l1: float = 1e-5, least: int = 4, screen: float = 4.5, seed: int = 1) -> Machine:
    """Screens terms, then fits the machine on those left.

    A term stays if it is in ``least`` documents and its count among label 1 is ``screen`` standard deviations off
    what chance gives. After a first fit, a term also stays if, taken together with the terms that count so far, it
    explains what the fit leaves over: those matter by interaction alone. Without documents of both classes the score
    is the share of label 1 (0 without any).
    """
    share = float(np.mean(labels)) if len(labels) else 0.0
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    none = Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < share < 1:
        return none

    def counted(weight: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for lo in range(0, len(docs), 1000):
            part = docs[lo : lo + 1000]
            each = None if weight is None else np.repeat(weight[lo : lo + 1000], [len(d) for d in part])
            total += np.bincount(np.concatenate(part), each, 1 << BITS)
        return total

    seen = counted()
    frequent = seen >= least
    off = np.abs(counted(labels) - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    active = frequent & (off > screen)

    def fitted(active: np.ndarray) -> Machine:
        kept = np.flatnonzero(active)
        index = np.full(1 << BITS, -1, np.int64)
        index[kept] = np.arange(len(kept))
        rows = [x[x >= 0] for x in (index[d] for d in docs)]
        b, w, v = _descend(rows, labels, len(kept), bias, epochs, rate, l1, seed)
        return Machine(b, kept, w, v)

    if not active.any():
        return none
    first = fitted(active)
    w, v = first.dense()
    guess = 1 / (1 + np.exp(-np.clip(raw_scores(first.bias, w, v, docs), -30, 30)))
    size = np.abs(w)
    strength = np.array([size[d].sum() for d in docs])
    spread = np.sqrt(counted(guess * (1 - guess) * strength**2))
    together = frequent & (np.abs(counted((labels - guess) * strength)) > screen * np.maximum(spread, 1e-3)) & (counted(strength) > 1)
    return fitted(active | together) if (together & ~active).any() else first


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether CRC-32 of the id as text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits on at most ``most`` labelled documents outside the held-out fold. Null labels and ids don't count; of
    several labels of one id the largest holds. Of rows that repeat an id, at most ``2 * most`` different ones count, by
    the hash of their terms."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(most)
    schema = arrow_schema("y double, terms array<int>")

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            found = [terms(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.types[1])], schema=schema)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(sample), "_id").select("_y", "_text")  # sample has at most `most` rows
    table = joined.mapInArrow(run, "y double, terms array<int>").distinct().orderBy(F.xxhash64("terms"), "y").limit(2 * most).toArrow()
    flat = table.column("terms").combine_chunks()
    at = np.concatenate(([0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))) if len(flat) else np.zeros(1, np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return fit([values[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], (table.column("y").to_numpy() > 0).astype(float))


def _scored(machine: Machine, texts: pa.Array, state: tuple) -> np.ndarray:
    buckets, w, v = state
    out = np.empty(len(texts))
    for lo in range(0, len(texts), 256):
        z = raw_scores(machine.bias, w, v, [terms(t.as_py(), buckets) for t in texts[lo : lo + 256]])
        out[lo : lo + len(z)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def toxic_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null, empty and wordless texts get the machine's constant. Repeated rows come back repeated, null ids stay null, an
    empty table gives an empty result, and other columns are ignored, whatever their names.
    """
    ddl = "doc_id long, held_out boolean, score double, predicted int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (_Buckets(), *machine.dense())
        for batch in batches:
            score = _scored(machine, batch.column(2), state)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)), F.col(text_col)).mapInArrow(run, ddl)


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5.

    Null, empty and wordless texts get the machine's constant, which is low unless most labels are 1; repeated rows go
    or stay together; an empty table gives an empty result; no name of a column can clash.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        state = (_Buckets(), *machine.dense())
        for batch in batches:
            yield batch.filter(pa.array(_scored(machine, batch.column(at), state) < 0.5))

    return docs.mapInArrow(run, docs.schema)
