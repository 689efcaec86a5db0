"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths are partitioned by reciprocal capacity: class ``k`` holds pieces of ``capacity // k`` tokens, and each of its
bins takes exactly ``k`` of them. A document is cut so that every piece meets the length of its class exactly: whole
sequences first, then always the longest class length that still fits, about three pieces for the rest. So a full bin
wastes less than its piece length, and never more than ``capacity % (capacity // k)`` tokens.

Bins are filled by workers independently: a table of piece counts by (partition, class), a few dozen rows for each
partition, gives each partition the place in each class where it begins, and piece ``i`` of a class lies in bin
``i // k``. Only the last bin of a class can be short. There are fewer than ``2 * sqrt(capacity)`` of those whatever
the corpus, and first-fit decreasing joins them on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, staged

CAPACITY = 2048
END_ID = 1
RUN = 4096
_LONG_RUN = re.compile(r"\s{%d}" % RUN)


class Tokenizer:
    """Byte-level BPE ids of whole texts as little-endian bytes, as ``tokenizers`` gives them with the tokenizer file.

    ``tiktoken`` gives the same ids in a ninth of the time, but cannot match runs of white space of some 100,000
    characters; texts with a run of over ``RUN`` go to ``tokenizers``.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer as Exact

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self.exact = Exact.from_file(public_tokenizers.path(f"{name}.json"))

    def ids(self, text: str) -> bytes:
        if _LONG_RUN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def class_lengths(capacity: int = CAPACITY) -> list[int]:
    """The piece lengths of the reciprocal-capacity classes, longest first."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cut_lengths(total: int, lengths: np.ndarray) -> list[int]:
    """Class lengths that sum to ``total``: whole sequences, then the longest that fits."""
    out = [int(lengths[0])] * (total // int(lengths[0]))
    left = total % int(lengths[0])
    while left:
        out.append(int(lengths[np.searchsorted(-lengths, -left)]))
        left -= out[-1]
    return out


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, worker, nth`` of each piece, and its ids if ``keep_ids``.

    ``nth`` counts the pieces of that length on that worker. Null and empty texts have the end id alone; null ids stay
    null; an empty table gives no pieces.
    """
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long" + ", ids binary" * keep_ids
    schema = arrow_schema(ddl)
    lengths = np.array(class_lengths(capacity))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, counts, tokenizer = TaskContext.get().partitionId(), {}, Tokenizer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = tokenizer.ids(text.as_py() or "") + end
                    start = 0
                    for length in cut_lengths(len(ids) // 4, lengths):
                        nth = counts.get(length, 0)
                        counts[length] = nth + 1
                        own = ids[start * 4 : (start + length) * 4]
                        rows.append((key, start, length, zlib.crc32(own), len(ids) // 4, worker, nth, own)[: 7 + keep_ids])
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def join_short_bins(short: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """First-fit decreasing of ``(class length, tokens)``; gives each its bin and its offset there."""
    bins: list[int] = []
    out = {}
    for length, tokens in sorted(short, key=lambda x: (-x[1], x[0])):
        at = next((i for i, used in enumerate(bins) if used + tokens <= capacity), len(bins))
        if at == len(bins):
            bins.append(0)
        out[length] = (at, bins[at])
        bins[at] += tokens
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece.

    Null and empty texts have the end id alone. Repeated rows are documents of their own. Long texts are cut into
    whole sequences and a rest. An empty table gives an empty result; other columns are ignored. Pieces are written
    to the shared folder once, so that what a worker counted and what is placed are the same rows.
    """
    spark = docs.sparkSession
    pieces = staged(tokenized_pieces(docs, capacity, id_col, text_col, keep_ids), "pieces")
    counts = pieces.groupBy("worker", "length").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("worker", "length", "begin")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per class
    base, full = 0, []
    short = join_short_bins([(m, n % (capacity // m) * m) for m, n in totals.items() if n % (capacity // m)], capacity)
    for m, n in sorted(totals.items()):
        per = capacity // m
        full.append((m, per, base, n // per, *short.get(m, (0, 0))))
        base += n // per
    classes = spark.createDataFrame([(m, per, at, bins, base + extra, offset) for m, per, at, bins, extra, offset in full], "length long, per long, base long, bins long, last long, shift long")
    # both tables are small by construction: a row per class, and a row per class and partition
    placed = pieces.join(F.broadcast(classes), "length").join(begins, ["worker", "length"]).withColumn("i", F.col("begin") + F.col("nth"))
    bin_, slot = F.floor(F.col("i") / F.col("per")), F.col("i") % F.col("per")
    inside = bin_ < F.col("bins")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.when(inside, F.col("base") + bin_).otherwise(F.col("last")).cast("long").alias("sequence_id"),
        (slot * F.col("length") + F.when(inside, 0).otherwise(F.col("shift"))).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
