import re

from ashlar.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def filled(sizes, weights, budget, cap):
    """Share out, clamp, reshare the excess by weight until nobody is above the cap."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), budget * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weights[s] / total
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def rows():
    out = [(i, "w " * (i % 37 + 1), f"s{i % 4}" if i % 9 else None, 1, "x") for i in range(300)]
    out += [(1000, None, "s1", 1, "x"), (1001, "", "s2", 1, "x"), (1002, " \t\n", "zero", 1, "x"), (1003, "w " * 30000, "s3", 1, "x")]
    return out + out[:5] + [(None, "a b c", "s0", 1, "x")]


def test_counts_follow_water_filling(spark):
    data = rows()
    got = mixing.mix_counts(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = {}
    by_id = {}
    for doc_id, _, source, *_ in data:
        by_id[doc_id] = source
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    again = mixing.mix_counts(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_documents_hold_the_counted_words(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    counts = mixing.mix_counts(df).collect()
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    found, want = {}, {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + words(r.text)
    for r in counts:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_counts(df).count() == 0 and mixing.mix_documents(df).count() == 0


def test_many_sources_join_by_shuffling(spark, monkeypatch):
    data = rows()
    few = sorted(map(str, mixing.mix_counts(spark.createDataFrame(data, SCHEMA)).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(str, mixing.mix_counts(spark.createDataFrame(data, SCHEMA)).collect())) == few
