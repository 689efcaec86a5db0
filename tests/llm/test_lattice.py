import itertools

import duckdb
import numpy as np
import pytest

from ashlar.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, h string, ring string"


def brute(rows, threshold=0.98):
    """The same by comparing all pairs: ``{(id, label, vector): (links, component)}``."""
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i, label, tuple(np.array(v, np.float32).tolist())] = None
    keys = list(good)
    links = {k: set() for k in keys}
    for a, b in itertools.combinations(keys, 2):
        if a[1] == b[1] and len(a[2]) == len(b[2]) and lattice.cosines(np.array([a[2]]), np.array([b[2]]))[0] >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[k] = (len(links[k]), min(s[0] for s in seen))
    return sorted((k[0], *v, k[0] == v[1]) for k, v in out.items())


def told(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, groups, spread, size=32):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for members in groups:
        centre = rng.normal(size=size)
        for _ in range(members):
            v = centre + rng.normal(size=size) * spread * rng.uniform(0.3, 1.3)
            rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 2)), "", ""))
            i += 1
    order = rng.permutation(len(rows))
    return [(int(o), *rows[k][1:]) for k, o in enumerate(order)]


@pytest.mark.parametrize("spread", [0.05, 0.14])
def test_links_of_groups_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 40)
    rows = corpus(3, [1] * 200 + [2] * 60 + [7] * 20 + [150], spread)
    assert told(lattice.linked_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("setting", range(len(lattice.SETTINGS)))
def test_pairs_at_the_threshold_meet(setting):
    """Each setting misses at most 1 in 1000 of 20,000 pairs whose cosine is the threshold; one in 5000 is expected."""
    most, *_ = lattice.SETTINGS[setting]
    rng = np.random.default_rng(setting)
    u, w = rng.normal(size=(2, 20000, 48))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    other = 0.98 * u + np.sqrt(1 - 0.98**2) * w
    cells = lattice.lattice(most)
    ring = np.zeros(2000, np.int64)
    missed = 0
    for lo in range(0, len(u), 2000):
        a, b = cells.visits(u[lo : lo + 2000], ring), cells.visits(other[lo : lo + 2000], ring)
        missed += int((~((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))).sum())
    assert missed <= 20


def test_decoding_is_nearest():
    rng = np.random.default_rng(0)
    near = lattice.shortest()
    assert len(near) == 240 and {int((v * v).sum()) for v in near} == {8}
    x = rng.normal(size=(500, 8)) * 3
    point = lattice.decode(x)
    assert ((point % 2 == point[:, :1] % 2).all(1) & (point.sum(1) % 4 == 0)).all()
    own = ((x - point / 2) ** 2).sum(1)
    assert (own[:, None] <= ((x[:, None] - (point[:, None] + near) / 2) ** 2).sum(2) + 1e-12).all() and own.max() <= 1 + 1e-12


def test_visits_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 33))
    unit, ring = x / np.linalg.norm(x, axis=1)[:, None], rng.integers(0, 1 << 60, 700)
    for setting in lattice.SETTINGS:
        cells = lattice.lattice(setting[0])
        whole = cells.visits(unit, ring)
        assert all((cells.visits(unit[lo : lo + n], ring[lo : lo + n]) == whole[lo : lo + n]).all() for lo, n in [(0, 1), (5, 17), (699, 1), (100, 256)])


def test_copies_bad_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    hot = [1.0] + [0.0] * 7
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, "", "") for i in range(60)]
    rows += [(i, hot, 1, "", "") for i in range(1000, 1300)]
    rows += [(1400, [2.0] + [0.0] * 7, 1, "", ""), (1401, [1.0, 0.1] + [0.0] * 6, 1, "", ""), (1402, hot, 2, "", ""), (1403, [1.0], 1, "", ""), (7, hot, 1, "", "")]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [None] + [1.0] * 7, 1), (2004, [float("nan")] * 8, 1), (2005, [float("inf")] * 8, 1), (2006, hot, None), (None, hot, 1)]
    df = spark.createDataFrame(rows + [(*b, "", "") for b in bad] + [rows[70]], SCHEMA)
    got = lattice.linked_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute(rows)
    again = next(w for w in want if w[0] == rows[70][0])
    alone = [(b[0], 0, b[0], True) for b in bad]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:3] == (None, None), str(r))
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted([*want, again, *alone], key=order)
    assert lattice.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered_query_against_its_sql(spark, tmp_path):
    from ashlar.llm import queries

    rows = corpus(9, [1] * 100 + [4] * 30, 0.08)
    spark.createDataFrame([(i, v, label) for i, v, label, *_ in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = told(queries.op13_lattice_near_dedup(spark, str(tmp_path)))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(lattice.ORACLE_SQL).fetchall()) == brute(rows)
    assert sum(r[1] for r in got) > 100
