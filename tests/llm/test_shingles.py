import random

import numpy as np
import pytest

from ashlar.llm import shingles

SCHEMA = "doc_id long, text string, k int"


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(data):
    sets = [slow_set(t) for _, t, _ in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both, either = len(x & sets[j]), len(x | sets[j])
            if both * 10 >= either * 8:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(data):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: least[root(i)] for i, (doc_id, *_) in enumerate(data)}


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [None, "", " \n", "one", "One two", "one two three four five"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("\n".join(copy))
    # a crowded passage that makes nobody similar, and one large group
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts += [" ".join([*base[:k], rng.choice(vocabulary), *base[k + 1 :]]) for k in range(60)]
    rng.shuffle(texts)
    return [(i * 3, t, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowded", [256, 4])
def test_against_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(shingles, "CROWDED", crowded)
    monkeypatch.setattr(shingles, "SAMPLE", 16 if crowded > 4 else 1)
    monkeypatch.setattr(shingles, "_BLOCK", 1024 if crowded > 4 else 8)
    monkeypatch.setattr(shingles, "_SPAN", 2)
    data = corpus()
    got = shingles.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == slow(data) and len(got) == len(data)


def test_crowded_shingles_are_cut_into_blocks(spark, monkeypatch):
    """No row holds more sets than a block; blocks of a shingle cover its sets once, by size; single sets go."""
    monkeypatch.setattr(shingles, "_BLOCK", 16)
    rng = random.Random(9)
    nodes = [(k, rng.randrange(5, 90), [7, 1000 + k] + ([8] if k % 3 else []) + ([9 + k // 2] if k < 40 else [])) for k in range(700)]
    rows = shingles._met(spark.createDataFrame(nodes, "node long, n int, prefix array<long>").repartition(6)).collect()
    assert max(len(r.met) for r in rows) <= 16 and len({r.blk for r in rows}) == len(rows)
    for tok in {t for _, _, p in nodes for t in p}:
        want = sorted((n, k) for k, n, p in nodes if tok in p)
        own = sorted((r for r in rows if r.tok == tok), key=lambda r: r.blk)
        got = [(m.n, m.node) for r in own for m in r.met]
        assert got == want or (len(want) == 1 and not got)
        assert len(own) < 2 or all(r.more for r in own)


@pytest.mark.parametrize(("block", "span"), [(4, 1), (8, 3), (1024, 16)])
def test_blocks_pair_as_whole_lists_do(spark, monkeypatch, block, span):
    """Pairs within and between blocks are those of all members of the shingle, components apart."""
    monkeypatch.setattr(shingles, "_BLOCK", block)
    monkeypatch.setattr(shingles, "_SPAN", span)
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 1 << 63, rng.integers(1, 9), np.uint64)))) for _ in range(120)]
    parities = [shingles._bits(x)[:64] for x in sets]
    comp = [k % 7 for k in range(len(sets))]
    nodes = spark.createDataFrame([(k, len(x), [5, 6 + k % 2]) for k, x in enumerate(sets)], "node long, n int, prefix array<long>").repartition(4)
    known = spark.createDataFrame([(k, c, bytearray(b)) for k, (c, b) in enumerate(zip(comp, parities, strict=True))], "node long, comp long, parities binary")
    entries = shingles._met(nodes).selectExpr("tok", "blk", "more", "inline(met)")
    blocks = shingles._apart(entries.join(known, "node"))
    found = blocks.where("not more").select("met").mapInArrow(shingles._across, "a long, b long").unionByName(shingles._spans(blocks.where("more")))
    want = set()
    for a, x in enumerate(sets):
        for b in range(a):
            differ = (int.from_bytes(parities[a]) ^ int.from_bytes(parities[b])).bit_count()
            small, large = sorted((len(x), len(sets[b])))
            if comp[a] != comp[b] and large * 8 <= small * 10 and differ * 18 <= (small + large) * 2:
                want.add((b, a))
    assert want and {tuple(r) for r in found.collect()} == want


def test_stage_links_at_similarity(spark):
    import corpus_pipeline

    data = corpus(6)
    df = spark.createDataFrame([*data, data[3], (None, "no id", 1)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and None in ids
    assert sorted(i for i in ids if i is not None) == sorted(set(slow(data).values()))
    assert shingles.drop_near_duplicates(df.limit(0)).count() == 0


def test_clashing_ids_lose_no_text(spark):
    """A text that is like no other stays, even where its id is that of a near copy; of equal rows one stays."""
    a = " ".join(f"a{k}" for k in range(60))
    b, near = " ".join(f"b{k}" for k in range(60)), a + " more"
    rows = [(5, a, 1), (5, b, 2), (6, near, 3), (5, a, 1), (7, b + " end", 4), (8, None, 5), (8, "", 6), (9, "  ", 7)]
    from ashlar.llm import simhash

    for drop in (shingles.drop_near_duplicates, simhash.drop_near_duplicates):
        kept = drop(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
        texts = sorted((r.doc_id, r.text or "") for r in kept)
        if drop is shingles.drop_near_duplicates:
            assert texts == [(5, a), (5, b), (8, "")]
        assert {(5, a), (5, b)} <= set(texts) and len([t for t in texts if t == (5, a)]) == 1


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 9000, np.uint64)
    for many in (0, 1, 500, 513, 3000):
        for other in (many, many + 700):
            x, y = (np.unique(rng.choice(pool, k)) for k in (many, other))
            one, two = shingles._bits(x), shingles._bits(y)
            assert 8 * len(one) >= max(512, len(x))
            size = min(len(one), len(two))
            a, b = (int.from_bytes(shingles._folded(z, size), "little") for z in (one, two))
            assert (a ^ b).bit_count() <= len(np.setxor1d(x, y))
            assert shingles._folded(one, 64) == shingles._bits(x)[:64] or len(one) > 64
