import numpy as np
import pytest

from ashlar.llm import ann

SCHEMA = "vec_id long, embedding array<float>, c int, ids string"


def exact(rows, every=50, k=5):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, a in good.items():
        if q % every == 0:
            near = sorted((-float(ann.cosines(a[None], b[None])[0]), i) for i, b in good.items() if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if kind == "clusters":
        x = (rng.normal(size=(300, 24))[rng.integers(0, 300, 3000)] * 3 + rng.normal(size=(3000, 24)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    lookup = dict(enumerate(x.astype(float)))
    for q, pairs in got.items():
        assert len(pairs) == 5 and pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - lookup[q] @ lookup[i] / np.linalg.norm(lookup[q]) / np.linalg.norm(lookup[i])) < 1e-12 for i, s in pairs)


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, "") for i in range(120)]
    hot = [1.0] + [0.0] * 7
    rows += [(i, hot, 0, "") for i in range(1000, 1400)]
    rows += [(2000, None, 0, ""), (2050, [], 0, ""), (2100, [0.0] * 8, 0, ""), (2150, [None] + [1.0] * 7, 0, ""), (2200, [float("nan")] * 8, 0, ""), (2250, [float("inf")] * 8, 0, "")]
    rows += [(None, hot, 0, ""), (3000, [1.0, 2.0], 0, ""), (3001, [2.0, 1.0], 0, ""), rows[50], rows[0]]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert not {2000, 2050, 2100, 2150, 2200, 2250} & set(got)
    assert [i for i, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005] and [i for i, _ in got[1050]] == [1000, 1001, 1002, 1003, 1004]
    assert [i for i, _ in got[3000]] == [3001]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items() if w]) >= 0.9
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probes_come_in_order_of_cost():
    sets = ann.perturbations(3, 27)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets)
    assert all(5 - r not in s for s in sets for r in s)
    assert len(ann.perturbations(3, 99)) == 27


def test_rare_lengths_and_outliers_are_complete(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, "") for i in range(1, 400)]
    rows += [(3000 + i, rng.normal(size=2).astype(np.float32).tolist(), 0, "") for i in range(4)]
    centres = rng.normal(size=(20, 16)) * 5
    rows += [(10_001 + i, (centres[i % 20] + rng.normal(size=16) / 50).astype(np.float32).tolist(), 0, "") for i in range(3000)]
    rows += [(20_000 + 50 * i, (rng.normal(size=16) * 3).astype(np.float32).tolist(), 0, "") for i in range(20)]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert {q: len(w) for q, w in want.items()} == {q: len(g) for q, g in got.items()}
    assert [i for i, _ in got[3000]] == [i for i, _ in want[3000]] == [3001, 3003, 3002]
    recall = {q: len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()}
    for lo, hi in ((0, 3000), (3000, 10_000), (10_000, 20_000), (20_000, 30_000)):
        assert np.mean([r for q, r in recall.items() if lo <= q < hi]) >= 0.9


def test_lengths_that_the_sample_misses_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 0, "") for i in range(1, 2000)]
    rows += [(5000 + 10 * i, rng.normal(size=9).astype(np.float32).tolist(), 0, "") for i in range(40)]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [i for i, _ in w] for q, w in want.items() if q >= 5000} == {q: [i for i, _ in g] for q, g in got.items() if q >= 5000}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9


def test_chance_agrees_with_drawn_tables():
    """The simulated chance is what real projections of real pairs at a distance give."""
    rng = np.random.default_rng(9)
    u, w = rng.normal(size=(2, 4000, 20))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    for setting in ann.SETTINGS[::3]:
        hasher = ann.Hasher(*setting)
        for cosine in (0.5, 0.9):
            other = cosine * u + np.sqrt(1 - cosine**2) * w
            met = np.any([(hasher.probed(u, t) == hasher.cells(other, t)[:, None]).any(1) for t in range(hasher.tables)], axis=0)
            assert abs(met.mean() - hasher.chance(np.sqrt(2 - 2 * cosine))) < 0.05


def test_exact_where_no_setting_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 1.1)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), 0, "") for i in range(1500)]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [i for i, _ in w] for q, w in want.items()} == {q: [i for i, _ in g] for q, g in got.items()}


def test_registered_query_against_brute_force(spark):
    from ashlar.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = exact(rows), found(queries.op6_ann_multiprobe(spark, sf))
    assert {q: len(w) for q, w in want.items()} == {q: len(g) for q, g in got.items()}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
