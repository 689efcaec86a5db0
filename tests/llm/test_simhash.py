import random
import re

import numpy as np
import pytest
import xxhash

from ashlar.llm import simhash

SCHEMA = "doc_id long, text string, fp string, k int"


def slow_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def corpus():
    rng = random.Random(3)
    vocabulary = [f"wört{i}" for i in range(400)] + ["The", "A", "of\x85x"]
    texts = [None, "", " \n\t ", "one", "One two", "ÀB cd"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            if rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("\n".join(copy))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(70000)))
    rng.shuffle(texts)
    return [(i * 3, t, "x", 1) for i, t in enumerate(texts)]


def expected(data):
    prints = [slow_print(t) for _, t, *_ in data]
    groups = components(prints)
    least = {}
    for (doc_id, *_), g in zip(data, groups, strict=True):
        least[g] = min(least.get(g, doc_id), doc_id)
    return sorted((d[0], f"{p:016x}", least[g]) for d, p, g in zip(data, prints, groups, strict=True))


@pytest.mark.parametrize("group", [1024, 1])
def test_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    data = corpus()
    data += [data[7], data[7]]
    got = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected(data)


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("group", [1024, 4, 1])
def test_links_of_close_fingerprints(spark, monkeypatch, most, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(most)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    found = simhash.links(df, most).collect()
    parent = {p - (p >> 63 << 64): p - (p >> 63 << 64) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 * 64
        parent[root(r.a)] = root(r.b)
    got = {}
    for p in prints:
        got.setdefault(root(p - (p >> 63 << 64)), set()).add(p)
    want = {}
    slow = {}
    for i, p in enumerate(prints):
        slow[i] = i

    def sroot(x):
        while slow[x] != x:
            x = slow[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                slow[sroot(i)] = sroot(j)
    for i, p in enumerate(prints):
        want.setdefault(sroot(i), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays(spark):
    data = corpus()
    data += [data[4], (None, "no id", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in expected([d for d in data if d[0] is not None])}
    assert None in ids and sorted(i for i in ids if i is not None) == sorted(want)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivots_discard_pairs_in_groups_of_every_size():
    rng = np.random.default_rng(2)
    sizes = [2] * 300 + [3] * 100 + [40] * 5 + [700]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    fps = rng.integers(0, 1 << 64, bounds[-1], np.uint64, endpoint=False)
    near = np.arange(0, len(fps) - 1, 7)
    fps[near + 1] = fps[near] ^ (np.uint64(1) << rng.integers(0, 64, len(near), np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(near), np.uint64))
    a, b, told = simhash.linked(fps, bounds, simhash.references(), 2)
    want = {(i, j) for s, e in zip(bounds[:-1], bounds[1:]) for i in range(s, e) for j in range(i + 1, e) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want
    met = sum(n * (n - 1) // 2 for n in sizes)
    assert told["met"] == met and told["discarded"] + told["refused"] + len(want) == met
    assert told["discarded"] > 0.98 * (met - len(want))
    _, _, twos = simhash.linked(fps[:600], bounds[:301], simhash.references(), 2)
    assert twos["discarded"] > 200


def test_clashing_columns(spark):
    texts = ["some words of a text here", "some words of a text here", "another one altogether, not like it", None, ""]
    df = spark.createDataFrame([(i, t, i, i, i, i) for i, t in enumerate(texts)], "doc_id long, text string, _kept int, _row int, fp int, component_id int")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r._kept, r._row, r.fp, r.component_id) for r in kept.collect()) == [(i,) * 5 for i in (0, 2, 3)]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
