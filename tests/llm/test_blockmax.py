import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ashlar.llm import blockmax

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item long, score string, terms string"
ITEMS = "item_id long, text string, block string"


def brute(docs, items, top=20):
    found = [(d, Counter(TERM.findall(t.translate(LOWER)))) for d, t, *_ in docs if t]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    count, words = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text, *_ in sorted(set(items), key=str):
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for d, c, n in found:
            m = 100 - 25 + 25 * n * count // words
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, docs=600, items=30):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "naïve", "Straße", "x1", "日本", "😀a"]
    draw = lambda n, topic: " ".join(rng.choice(words[topic * 30 : topic * 30 + 60] if rng.random() < 0.7 else words) for _ in range(n))
    rows = [(i, draw(rng.choice([1, 5, 40, 40, 200]), i * 8 // docs), 0, "", "") for i in range(docs)]
    asked = [(k, draw(rng.choice([1, 6, 30]), k % 8), "") for k in range(items)]
    return rows, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(blockmax, "DOCS", 7)
    monkeypatch.setattr(blockmax, "POSTINGS", 150)
    rows, asked = corpus(seed)
    rows += [(100 + k, rows[100][1], 0, "", "") for k in range(60)]  # ties
    assert told(blockmax.ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS))) == brute(rows, asked)


def test_sets_of_queries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "ITEMS", 7)
    monkeypatch.setattr(blockmax, "TERMS", 60)
    rows, asked = corpus(3, 200, 16)
    assert told(blockmax.ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS))) == brute(rows, asked)


def test_odd_rows(spark):
    rows = [(1, None, 0, "", ""), (2, "", 0, "", ""), (3, " ._- ", 0, "", ""), (4, "Alpha beta ALPHA", 0, "", ""), (None, "alpha beta alpha", 0, "", ""), (5, "alpha  beta\nalpha", 0, "", ""), (5, "alpha beta alpha", 0, "", ""), (6, "ÀB àb", 0, "", ""), (7, "gamma " * 50000 + "beta", 0, "", "")]
    rows += [(50 + k, "delta", 0, "", "") for k in range(30)]
    asked = [(1, "alpha", ""), (1, "alpha", ""), (2, None, ""), (3, "..", ""), (4, "àb", ""), (5, "beta beta delta", ""), (6, "unknown", "")]
    got = told(blockmax.ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS)))
    assert got == brute(rows, asked)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1] == [4, 5, 5, None]
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(asked, ITEMS)
    assert told(blockmax.ranked(none, some)) == [] == told(blockmax.ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], ITEMS)))


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """Bounds hold for every document, and a search by bounds scores few of the blocks."""
    rng = np.random.default_rng(0)
    queries = blockmax.QuerySet.of([(0, [b"a", b"b", b"b"]), (1, [b"c"])])
    scorer = blockmax.Scorer(queries, np.array([3, 5, 7]))
    import pyarrow as pa

    columns = {k: [] for k in ("block", "ids", "sizes", "terms", "shares", "top_terms", "top_shares")}
    for b in range(50):
        sizes = rng.integers(0, 3, 6)
        term = np.concatenate([np.sort(rng.permutation(3)[:s]) for s in sizes]).astype(np.int32)
        share = rng.integers(1, 10 + b, len(term)).astype(np.int32)
        names = np.unique(term).astype(np.int32)
        for k, v in zip(columns, (b * 6, list(range(b * 6, b * 6 + 6)), sizes.astype(np.int32), term, share, names, np.array([share[term == n].max() for n in names], np.int32)), strict=True):
            columns[k].append(v)
    batch = pa.RecordBatch.from_pydict(columns)
    bounds = scorer.bounds(batch)
    every = [[scorer.scores(scorer.by_term(batch, r), q) for r in range(50)] for q in range(2)]
    for q in range(2):
        assert all(every[q][r].max() <= bounds[r, q] for r in range(50))
        best, scored = blockmax.Best(np.zeros(2, np.int64)), 0
        for r in np.argsort(-bounds[:, q]):
            if bounds[r, q] < best.least[q]:
                break
            best.add(q, every[q][r], r * 6, list(range(r * 6, r * 6 + 6)))
            scored += 1
        flat = sorted(((-int(s), r * 6 + k) for r in range(50) for k, s in enumerate(every[q][r]) if s > 0))[:20]
        assert sorted((-s, -a) for s, a, _ in best.heaps[q]) == flat and scored < 50


def test_registered_query_against_its_sql(spark):
    from ashlar.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(db.execute(blockmax.ORACLE_SQL).fetchall(), key=str)
    assert want and told(queries.op12_block_max_search(spark, sf)) == want
