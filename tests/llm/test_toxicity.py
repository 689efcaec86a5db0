import random
import zlib

import numpy as np

from ashlar.llm import toxicity


def plain_score(machine, text):
    """The machine by its definition, over all pairs."""
    w, v = machine.dense()
    found = toxicity.terms(text, toxicity._Buckets())
    z = machine.bias + sum(w[i] for i in found)
    z += sum(v[i] @ v[j] for a, i in enumerate(found) for j in found[:a])
    return 1 / (1 + np.exp(-z))


def corpus(n, seed=5):
    """Label 1: an insult anywhere, or a mild word together with a group."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randrange(5, 120))]
        mild, group, insult = rng.random() < 0.35, rng.random() < 0.35, rng.random() < 0.08
        words += ["pests"] * mild + ["groupies"] * group + [rng.choice(["Idiot!", "SCUM", "moron,"])] * insult
        rng.shuffle(words)
        docs.append((i, " ".join(words), int(insult or mild and group)))
    return docs


def test_interactions_are_learned(spark):
    docs = corpus(3000)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    rows = {r.doc_id: r for r in toxicity.toxic_scores(df, machine).collect()}
    assert len(rows) == 3000
    out = [(rows[i], t, y) for i, t, y in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, *_ in out) and sum(r.held_out for r in rows.values()) == len(out)
    assert np.mean([r.predicted == y for r, _, y in out]) > 0.97
    for r, text, _ in out[:40]:
        assert abs(r.score - plain_score(machine, text)) < 1e-9
    kept = toxicity.drop_toxic(df, machine)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if not r.predicted)


def test_edges(spark):
    docs = corpus(300) + [(900, None, 1), (901, "", 0), (902, "... ###", 0), (None, "idiot", 1), (903, "scum " * 50_000, 1), (3, "again", 0)]
    df = spark.createDataFrame([(i, t, y, "c") for i, t, y in docs], "doc_id long, text string, toxic int, score string")
    machine = toxicity.train(df, df)
    rows = toxicity.toxic_scores(df, machine).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    constant = {round(r.score, 12) for r in rows if r.doc_id in (900, 901, 902)}
    assert len(constant) == 1
    empty = df.limit(0)
    assert toxicity.toxic_scores(empty, machine).count() == 0
    nothing = toxicity.train(df, df.where("toxic is null"))
    assert {r.predicted for r in toxicity.toxic_scores(df, nothing).collect()} == {0}
    single = toxicity.train(df, df.where("toxic = 1"))
    assert all(r.score > 0.99 for r in toxicity.toxic_scores(df, single).collect())


def test_repeated_ids_keep_both_labels(spark):
    rows = [(i, f"calm words {i} here", 0) for i in range(60)] * 100 + [(200 + i, f"idiot number {i} there", 1) for i in range(60)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    machine = toxicity.train(df, df, most=60)
    got = {r.doc_id: r.predicted for r in toxicity.toxic_scores(df.distinct(), machine).collect()}
    assert np.mean([got[i] == (i >= 200) for i in got]) > 0.9


def test_drop_toxic_edges(spark):
    docs = [(1, None, "a"), (2, "", "b"), (3, "scum", "c"), (3, "scum", "c"), (None, "calm", "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bucket = toxicity.terms("scum", toxicity._Buckets())
    machine = toxicity.Machine(-3.0, bucket.astype(np.int64), np.array([9.0]), np.zeros((1, toxicity.FACTORS)))
    out = toxicity.drop_toxic(df, machine)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    assert toxicity.drop_toxic(df.limit(0), machine).count() == 0
