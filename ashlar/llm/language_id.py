"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a boundary, and its 1- to ``ORDER``-grams of code points are
hashed to ``2 ** BITS`` buckets. A bucket's value is its share of the text's n-grams, in per cent, times its inverse
document frequency. The weights come from follow-the-regularised-leader with elastic-net penalties, which leaves most
of them zero; a temperature fitted on documents kept from training calibrates the probabilities.

Document frequencies are counted over all learning documents. The weights are fitted on the driver from at most ``most``
documents (default ``TRAIN_ROWS``), taken from the languages in turn, each time the one with the next smallest seeded
hash of its id, so a rare language is not lost. Since values are shares, a text's score is the mean of one table row per n-gram: scoring reads whole
texts in Arrow tasks in constant memory per chunk and moves no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, first_of_each, slices

BITS = 17
ORDER = 3
TRAIN_ROWS = 3000
UNKNOWN = "und"
_CHUNK = 1 << 18
#: Fixed odd values, one for each place in an n-gram.
_PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two boundaries; a run of non-letters is one boundary."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(_letters()[raw], raw, np.uint32(0))
    kept = np.concatenate((np.zeros(1, np.uint32), kept, np.zeros(1, np.uint32)))
    return kept[np.r_[True, (kept[1:] != 0) | (kept[:-1] != 0)]]


def buckets(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of each order; a boundary alone is not an n-gram of order 1."""
    out, total = [], np.zeros(len(points), np.uint32)
    for n in range(min(ORDER, len(points))):
        total = total[: len(points) - n] + points[n:] * np.uint32(_PLACES[n])
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        mixed ^= mixed >> np.uint32(12)
        found = (mixed * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)
        out.append(found[points != 0] if n == 0 else found)
    return out


@dataclass
class Model:
    langs: list[str]
    bias: np.ndarray
    table: np.ndarray  # [bucket, language]: idf times weight
    temperature: float

    def logits(self, points: np.ndarray) -> np.ndarray:
        """Raw scores of one text."""
        total, count = np.zeros(len(self.langs)), 0
        for lo in range(0, len(points), _CHUNK):
            # chunks overlap so that no n-gram is lost or counted twice
            for n, found in enumerate(buckets(points[lo : lo + _CHUNK + ORDER - 1])):
                own = found if n else found[: np.count_nonzero(points[lo : lo + _CHUNK])]
                own = own if not n else own[:_CHUNK]
                total += self.table[own].sum(0, dtype=np.float64)
                count += len(own)
        return self.bias + 100 * total / max(count, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        points = codes(text)
        if not self.langs or not points.any():
            return UNKNOWN, 0.0
        z = self.logits(points) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3, df: np.ndarray | None = None, seen: int = 0) -> Model:
    """FTRL over documents given as ``(buckets, occurrences)``; every fifth document only calibrates.

    ``df`` are the document frequencies of the buckets in ``seen`` documents (default: those given). Without documents
    the model knows no language and finds none.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0), np.float32), 1.0)
    y = np.array([names.index(x) for x in langs])
    if df is None:
        df, seen = np.bincount(np.concatenate([b for b, _ in counts]), minlength=1 << BITS), len(counts)
    idf = np.log((1 + seen) / (1 + df)) + 1
    rows = [(b, 100 * n / max(n.sum(), 1) * idf[b]) for b, n in counts]
    order = np.random.default_rng(seed).permutation(len(rows))
    kept = order[::5] if len(order) >= 20 else order
    learn = np.setdiff1d(order, kept, assume_unique=True) if len(order) >= 20 else order
    width = len(names)
    z, n = np.zeros((1 << BITS, width)), np.zeros((1 << BITS, width))
    zb, nb = np.zeros(width), np.zeros(width)

    def weights(z: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))

    def softmax(s: np.ndarray) -> np.ndarray:
        p = np.exp(s - s.max())
        return p / p.sum()

    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-3000 // max(len(learn), 1)))):
        for k in rng.permutation(learn):
            b, x = rows[k]
            w, wb = weights(z[b], n[b], l1), weights(zb, nb, 0.0)
            error = softmax(wb + x @ w)
            error[y[k]] -= 1
            g = x[:, None] * error
            more = n[b] + g * g
            z[b] += g - (np.sqrt(more) - np.sqrt(n[b])) / alpha * w
            n[b] = more
            more = nb + error**2
            zb += error - (np.sqrt(more) - np.sqrt(nb)) / alpha * wb
            nb = more
    w, bias = weights(z, n, l1), weights(zb, nb, 0.0)
    scores = np.array([bias + rows[k][1] @ w[rows[k][0]] for k in kept])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(kept)), y[kept]]).mean())

    temperature = min(np.geomspace(0.1, 20, 200), key=loss)
    return Model(names, bias, (w * idf[:, None]).astype(np.float32), float(temperature))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (one column) each bucket occurs, and how many texts have a letter.

    A task sums its documents first; at most ``2 ** BITS`` sums reach the driver.
    """
    ddl = "bucket int, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                points = codes(text.as_py())
                if points.any():
                    mask = np.zeros(1 << BITS, bool)
                    for lo in range(0, len(points), _CHUNK):
                        for found in buckets(points[lo : lo + _CHUNK + ORDER - 1]):
                            mask[found] = True
                    total += mask
                    seen += 1
        some = np.flatnonzero(total)
        columns = [np.append(some, -1).astype(np.int32), np.append(total[some], seen)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    sums = texts.mapInArrow(run, ddl).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()  # -1 is the last place
    return out[:-1], int(out[-1])


def fold(id_col: Column, folds: int = 3) -> Column:
    """CRC-32 of the id as text, by its remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, most: int = TRAIN_ROWS, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on documents with an id, a text with a letter and a language, outside the held-out fold: document
    frequencies on all of them, weights on at most ``most``. Of rows that repeat an id, at most ``2 * most`` different
    ones count, by the hash of their n-grams."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    own = own.where("_id is not null and _lang is not null and _text is not null").where(fold(F.col("_id")) != held_out)
    df, seen = document_frequencies(own.select("_text"))
    order = [F.xxhash64("_id", F.lit(23)), F.col("_id")]
    # in turn: the first of each language, the second of each, and so on
    ranked = first_of_each(own.select("_id", "_lang").distinct(), "_lang", order, most)
    chosen = ranked.orderBy("_n", *order, "_lang").limit(most).select("_id").distinct()
    ddl = "lang string, buckets array<int>, counts array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points = codes(text.as_py())
                if points.any():
                    b, n = np.unique(np.concatenate(buckets(points)), return_counts=True)
                    found.append((lang, b.astype(np.int32), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(schema.types)], schema=schema)

    joined = own.join(F.broadcast(chosen), "_id").select("_lang", "_text")  # at most `most` ids
    rows = joined.mapInArrow(run, ddl).distinct().orderBy(F.xxhash64("buckets", "counts"), "lang").limit(2 * most).toArrow().to_batches()
    counts, langs = [], []
    for batch in rows:
        langs += batch.column(0).to_pylist()
        counts += [(b.values.to_numpy(), n.values.to_numpy()) for b, n in zip(batch.column(1), batch.column(2), strict=True)]
    return fit(counts, langs, df=df, seen=seen)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    ``und`` with score 0 where the text is null, empty or without a letter. Repeated rows come back repeated, null ids
    stay null, an empty table gives an empty result, and other columns are ignored, whatever their names.
    """
    ddl = "doc_id long, held_out boolean, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=schema
            )

    return docs.select(F.col(id_col).cast("long"), fold(F.col(id_col)) == 1, F.col(text_col)).mapInArrow(run, ddl)
