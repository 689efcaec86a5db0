import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from ashlar.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, g int, hashes string"


def slow(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"wö{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(window - 3, 2 * window))] for _ in range(6)]
    docs = []
    for i in range(120):
        words = [f"u{rng.randrange(5000)}" if rng.random() < 0.8 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    docs += [(i + 1000, docs[i * 3][1]) for i in range(10)]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a " * 3000), (2004, "b c " * (window // 2)), (2005, "x " * window), (2006, "y " * (window + 1)), docs[5], docs[5], (None, docs[9][1])]
    return docs


@pytest.mark.parametrize("window", [35, 8])
def test_against_all_windows(spark, window):
    docs = corpus(window, window)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(5)
    got = sd.remove_repeats(df, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(docs, window)


def test_a_long_text_of_one_passage(spark):
    unique = " ".join(f"n{i}" for i in range(60_000))
    docs = [(1, unique), (2, "head " + " ".join(f"n{i}" for i in range(20_000, 20_040)) + " tail")]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=True).collect()}
    assert got[2].kept == "head tail" and (got[1].n_removed, got[1].n_words) == (40, 60_000)


def test_rolling_hash_of_doubles():
    words = np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64)
    words[20:40] = words[:20]
    for size in range(1, 21):
        found = sd.rolling(words, size)
        assert len(found) == 51 - size
        assert (found[: 21 - size] == found[20 : 41 - size]).all() and len(np.unique(found)) == len(found) - (21 - size)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes_depend_on_the_words_alone(monkeypatch):
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abc\xc3\x85\x1c") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(500)]
    data = b"".join(w + rng.choice([b" ", b"\n\t", b"\x0b\x0c\r"]) for w in words)
    for piece in (1 << 20, 64):
        monkeypatch.setattr(sd, "_PIECE", piece)
        starts, hashes = sd.word_hashes(data)
        assert [data[s:].split()[0] for s in starts.tolist()] == words
        by_word = {}
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)
    assert len(sd.word_hashes(b"")[0]) == 0
