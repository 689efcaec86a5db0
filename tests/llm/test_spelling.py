import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ashlar.llm import spelling

DOCS = "doc_id long, text string, word string, n int, w int, key string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeé") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straßen÷×", "ÀÉÈùúûü", "ÿÿabcdef"]

    def spoilt(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeéz") + w[i:], w[:i] + rng.choice("abeéz") + w[i + 1 :]])

    rows = []
    for doc in range(120):
        some = [rng.choice(base) for _ in range(60)]
        some = [spoilt(w) if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 else w for w in some]
        rows.append((doc, rng.choice([" ", ", ", "1", "日", "😀"]).join(some), "", 0, 0, ""))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 50)
    rows = corpus(seed)
    want = brute(rows)
    assert told(spelling.variants(spark.createDataFrame(rows, DOCS))) == want
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_chains_of_forms_reach_their_root(spark):
    words = [("abcdefgh", 3000), ("abcdefgx", 250), ("abcdefyx", 22), ("abcdezyx", 2), ("qrstuvwx", 30), ("qrstuvwxy", 3), ("qrstuvw", 3), ("qrstuvz", 3)]
    rows = [(k * 31 + d, " ".join([w] * (n // 2)), "", 0, 0, "") for k, (w, n) in enumerate(words) for d in (0, 1)]
    got = told(spelling.variants(spark.createDataFrame(rows, DOCS)))
    assert got == brute(rows)
    assert {r[2] for r in got if r[0].startswith("abcde") and len(r[0]) == 8} == {"abcdefgh"}


def test_collisions_are_verified_on_strings(spark, monkeypatch):
    """Keys of eight values only: every group is wrong, the result is not."""
    real = spelling.deletion_keys

    def crowded(words):
        key, word, place = real(words)
        return key % 8, word, place

    monkeypatch.setattr(spelling, "deletion_keys", crowded)
    rows = corpus(4)[:30]
    assert told(spelling.variants(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_equal_strings_have_equal_keys():
    words = [b"abcdefg", b"abxdefg", b"abdefg", b"aabbccc", b"\xe9\xe8abcde"]
    key, word, place = spelling.deletion_keys(words)
    named: dict = {}
    for k, w, p in zip(key.tolist(), word.tolist(), place.tolist(), strict=True):
        at = p >> 1
        text = words[w] if p < 0 else words[w][:at] + words[w][at + 1 :]
        named.setdefault(("same", at, text) if p >= 0 and not p & 1 else ("other", text), set()).add(k)
    assert all(len(k) == 1 for k in named.values()) and len(set().union(*named.values())) == len(named)


def test_odd_rows(spark):
    long_ = "abcdefghij" * 20000
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "nothing nothing"), (4, "nothing nothinx nothinx"), (4, "nothing nothinx nothinx"), (5, long_ + " " + long_), (6, long_[1:] + " " + long_[1:] + " " + long_[:-1] + "x " + long_[:-1] + "x")]
    rows = [(*r, "", 0, 0, "") for r in rows]
    assert told(spelling.variants(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_registered_query_against_its_sql(spark):
    from ashlar.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(spelling.ORACLE_SQL).fetchall(), key=str)
    assert want and told(queries.op11_spelling_variants(spark, sf)) == want
