import random
import zlib
from collections import Counter

import numpy as np

from ashlar.llm import language_id as li

WORDS = {"en": "the and of with house water seven", "de": "der und von mit häuser wasser sieben schön", "fr": "le et des avec maison l'eau sept été"}


def corpus(n):
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_grams_against_plain_counting():
    text = "Ab, c9'É — ab"
    plain = "\0" + "".join(c for c in "ab\0c\0é\0ab") + "\0"
    assert "".join(map(chr, li.codes(text))) == plain
    grams = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != "\0")
    found = Counter(np.concatenate(li.buckets(li.codes(text))).tolist())
    assert sorted(found.values()) == sorted(grams.values())


def test_chunks_change_nothing(monkeypatch):
    counts = [(np.unique(np.concatenate(li.buckets(li.codes(t))), return_counts=True), lang) for _, t, lang in corpus(90)]
    model = li.fit([c for c, _ in counts], [x for _, x in counts])
    points = li.codes("wasser und water, l'eau " * 200)
    whole = model.logits(points)
    monkeypatch.setattr(li, "_CHUNK", 7)
    assert np.allclose(model.logits(points), whole)
    b, n = np.unique(np.concatenate(li.buckets(points)), return_counts=True)
    assert np.allclose(whole, model.bias + 100 * (n / n.sum()) @ model.table[b].astype(float))


def test_held_out_accuracy_and_edges(spark):
    docs = corpus(600) + [(900, None, "en"), (901, "", "de"), (902, "12 — 34 !", "fr"), (903, "the water " * 60_000, "en"), (None, "der wasser", "de"), (5, "again the house", None)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in docs], "doc_id long, text string, lang string, score string")
    model = li.train(df)
    rows = li.predict_languages(df, model).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    out = [(i, lang) for i, _, lang in docs[:600] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by_id[i].held_out for i, _ in out) and np.mean([by_id[i].lang_pred == lang for i, lang in out]) > 0.97
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    nothing = li.train(df.where("lang is null"))
    assert {r.lang_pred for r in li.predict_languages(df, nothing).collect()} == {"und"}
    assert li.predict_languages(df.limit(0), model).count() == 0


def test_repeated_ids_and_rare_languages(spark):
    rows = [(i, WORDS["en"], "en") for i in range(60)] * 200 + [(i, WORDS["fr"], "fr") for i in range(60)] * 200 + [(7000 + i, WORDS["de"], "de") for i in range(6)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8), most=60)
    assert model.langs == ["de", "en", "fr"] and model.predict("der und von mit häuser")[0] == "de"


def test_document_frequencies_cover_all_texts(spark):
    texts = [t for _, t, _ in corpus(120)] + [None, "", "12 3"]
    df, seen = li.document_frequencies(spark.createDataFrame([(t,) for t in texts], "t string").repartition(4))
    want = Counter()
    for t in texts:
        want.update(set(np.concatenate(li.buckets(li.codes(t))).tolist()) if li.codes(t).any() else ())
    assert seen == 120 and {int(b): int(df[b]) for b in np.flatnonzero(df)} == dict(want)
