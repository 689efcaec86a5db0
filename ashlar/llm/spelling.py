"""Spelling variants: words one code point apart, grouped under far more frequent forms.

*Keys.* A word's deletions are hashed without building them: with prefix sums of a polynomial in an odd base modulo 2^64,
the word without its code point ``i`` hashes to its prefix before ``i`` plus its suffix behind it, shifted by one place.
NumPy does this for all deletions of a batch of words at once. Two words of one length that differ at ``i`` agree in the
deletion at ``i``, so ``i`` is part of that key; a word and one that is longer by a code point agree in the shorter word
and a deletion of the longer, under keys of a second kind (deletions within a run of equal letters are one).

*Groups.* Keys are dealt by hash and sorted as whole numbers; only those that several words hold go on and get their
strings. Equal keys are verified on the strings: words count as a group when they give the same string. Of a group every
member counts the others and keeps the best of them, so pairs are never formed. A group of the first kind has one word
for each letter at most, one of the second a few for each position.

*Roots.* Forms are followed by pointer doubling: a form is at least ten times as frequent, so a chain of forms has at most
as many steps as the largest count has digits, and a handful of joins reaches every end.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, partitions, slices, staged

LEAST = 7
ODDS = 31
FACTOR = 10
_HELD = 100_000
_PARTS = 1 << 18
# one byte for each code point of a run, all others become spaces
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """Runs of letters in a text with their counts, one byte a code point, some with a deleted one.

    Only those of at least ``LEAST`` code points. A run loses a code point where the crc32 of ``<doc_id>:<run>`` is
    divisible by ``ODDS``, at the place the crc32 names; null ids are written as nothing.
    """
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_SPLIT).split() if text else ()).items():
        if len(run) >= LEAST:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
            if h % ODDS == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) < LEAST:
                    continue
            yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all whole texts that occur at least twice. Tasks add up before words are shuffled."""
    schema = arrow_schema("word string, n long")

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc, text.as_py()):
                    held[word] += n
                if len(held) >= _HELD:
                    yield told(held)
                    held = Counter()
        yield told(held)

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, word, place``: a key for each deletion of each word, and the keys that words of unequal length share.

    ``place`` is twice the place for a key of the first kind, twice the place and one for a deletion under a key of the
    second kind, and -1 for a word under its own.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - starts[word]
    with np.errstate(over="ignore"):
        powers = np.full(int(sizes.max(initial=0)), _BASE, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        value = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers[place], dtype=np.uint64)))
        prefix = total[:-1] - total[starts][word]
        suffix = total[(starts + sizes)[word]] - total[1:]
        without = prefix + suffix * np.uint64(_BACK)
        whole = total[starts + sizes] - total[starts]
        size = sizes[word].astype(np.uint64)

        def mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + salt * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(32))).view(np.int64)

        same = mixed(without, place.astype(np.uint64) * np.uint64(2) + np.uint64(2))
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
        shorter = mixed(without[new], (size[new] - np.uint64(1)) * np.uint64(2) + np.uint64(1))
        own = mixed(whole, sizes.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    keys = np.concatenate((same, shorter, own))
    return keys, np.concatenate((word, word[new], np.arange(len(words)))), np.concatenate((place * 2, place[new] * 2 + 1, np.full(len(words), -1)))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same sorted rows, cut where the key changes."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut)
    if held is not None:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key stands in another row too."""
    for rows in _whole_keys(batches):
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        if same.any():
            yield from rows.filter(pa.array(np.concatenate((same, [False])) | np.concatenate(([False], same)))).combine_chunks().to_batches()


_Word = tuple[int, str, int]


def near_words(members: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, _Word]]:
    """``word, number of near words, best of them`` for each verified group among the words ``(place, id, word, n)`` of
    one key; the best has the largest count, then the smallest string."""
    groups: dict[tuple[str, int], list[_Word]] = {}
    for place, w, word, n in members:
        at = place >> 1
        text = word if place < 0 else word[:at] + word[at + 1 :]
        # under a key of the second kind the place does not matter, only who is the shorter
        groups.setdefault((text, -1 if place < 0 else -2 if place & 1 else at), []).append((-n, word, w))
    for (text, at), own in groups.items():
        if at >= 0 and len(own) > 1:
            first, second = sorted(own)[:2]
            for x in own:
                yield x[2], len(own) - 1, second if x == first else first
        elif at == -1 and (longer := groups.get((text, -2))):
            yield own[0][2], len(longer), min(longer)
            for x in longer:
                yield x[2], 1, own[0]


_NEAR_DDL = "w long, n_near long, form_n long, form string, form_w long"


def _counted(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_keys(batches):
        found = []
        named = zip(*(rows.column(c).to_pylist() for c in ("key", "place", "w", "word", "n")), strict=True)
        for _, own in itertools.groupby(named, key=lambda r: r[0]):
            found += [(w, near, -best[0], best[1], best[2]) for w, near, best in near_words([r[1:] for r in own])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)


def roots(forms: DataFrame) -> DataFrame:
    """``w, root``: the last word reached from each ``w`` by its ``form_w``. Forms must not lead round in a circle."""
    current = staged(forms.select("w", F.col("form_w").alias("root")), "spelling-forms")
    while True:
        onward = current.select(F.col("w").alias("root"), F.col("root").alias("next"))
        stepped = staged(current.join(onward, "root", "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        current = stepped.select("w", "root")
        if stepped.where("moved").isEmpty():
            return current


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per distinct word of at least 7 letters that occurs twice or more.

    Words are runs of ASCII letters and U+00C0 to U+00FF in whole texts, A-Z lower-cased, of which one in 31 per document
    loses a code point. ``n_near`` counts the words one insertion, deletion or replacement away; ``form`` is the most
    frequent of them (of equals the smallest string) where it is at least 10 times as frequent, else null; ``root`` is
    the end of the chain of forms, the word itself if it has none. Null and empty texts have no words, repeated rows
    count again, null ids are written as nothing before the colon; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    parts = partitions(docs.sparkSession)
    words = staged(word_counts(docs, id_col, text_col).withColumn("w", F.monotonically_increasing_id()), "spelling-words")
    key_ddl = "key long, w long, place int"
    key_schema, near_schema = arrow_schema(key_ddl), arrow_schema(_NEAR_DDL)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            key, word, place = deletion_keys([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            ids = batch.column("w").to_numpy()
            for lo in range(0, len(key), _PARTS):
                own = slice(lo, lo + _PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(ids[word[own]]), pa.array(place[own].astype(np.int32))], schema=key_schema)

    keys = words.select("w", "word").mapInArrow(keyed, key_ddl)
    shared = staged(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, key_ddl), "spelling-keys")
    named = shared.join(words, "w").select("key", "place", "w", "word", "n").repartition(parts, "key").sortWithinPartitions("key")
    found = named.mapInArrow(lambda batches: _counted(near_schema, batches), _NEAR_DDL)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form", "form_w"))
    near = staged(found.groupBy("w").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("w", "n_near", (-F.col("b.less")).alias("form_n"), "b.form", "b.form_w"), "spelling-near")
    held = words.join(near, "w", "left")
    follows = F.col("form_n") >= FACTOR * F.col("n")
    ends = roots(held.where(follows).select("w", "form_w"))
    named_ends = ends.join(words.select(F.col("w").alias("root"), F.col("word").alias("root_word")), "root").select("w", "root_word")
    return held.join(named_ends, "w", "left").select(
        "word",
        F.when(follows, F.col("form")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("form_n")).alias("form_n"),
    )


#: The crc32 is folded over bytes with the usual table of its reflected polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
coded AS (
  SELECT run, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS points
  FROM counted
),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded CROSS JOIN crc_table
),
spoilt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
without AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM places),
near AS (
  SELECT a.word AS word, b.word AS other FROM without a JOIN without b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM without a JOIN words w ON a.d = w.word
  UNION SELECT w.word, a.word FROM without a JOIN words w ON a.d = w.word
),
best AS (
  SELECT near.word, count(*) AS n_near, first(near.other ORDER BY o.n DESC, near.other) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word
),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN ends e USING (word)
"""
