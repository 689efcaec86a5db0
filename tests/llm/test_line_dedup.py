import random

import numpy as np
import pytest

from ashlar.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, class string, first int"


def slow(docs):
    """Every two documents that share a line, aligned on all the lines they share."""
    first, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in docs}):
        first.setdefault(t, i)
    reps = sorted((i, t) for t, i in first.items())
    lines = {i: [x.strip(" \t\n\v\f\r") for x in t.split("\n") if x.encode().split()] for i, t in reps}
    gone = {i: set() for i, _ in reps}
    for n, (later, _) in enumerate(reps):
        for earlier, _ in reps[:n]:
            if both := set(lines[later]) & set(lines[earlier]):
                number = {x: k for k, x in enumerate(sorted(both))}
                a = {p: number[x] for p, x in enumerate(lines[later]) if x in number}
                b = {p: number[x] for p, x in enumerate(lines[earlier]) if x in number}
                gone[later] |= set(ld.common_blocks(a, b, {p: len(lines[later][p].encode().split()) for p in a}))
    for i, t in {(i, t) for i, t in docs}:
        text = t or ""
        copy = i != first[text] and len(text.split()) >= ld.MIN_WORDS
        out[i, t] = ld.drop_lines(text, None if copy else gone[i] if i == first[text] else set())[0] if t is not None else None
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    hot = ["Licensed to all under the same terms as ever", "short line"]
    docs = []
    for i in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"own {i} {k} " + "x y z" for k in range(rng.randrange(1, 14))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines)), rng.choice(hot))
        if docs and rng.random() < 0.4:
            other = rng.choice(docs)[1].split("\n")
            cut = rng.randrange(len(other))
            lines[1:1] = other[cut : cut + rng.randrange(1, 6)]
        lines.insert(rng.randrange(len(lines)), " ")
        docs.append((i, "\n".join(lines)))
    for _ in range(15):
        docs.append((len(docs), rng.choice(docs)[1]))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    docs += [(500, None), (501, ""), (502, "\n \n"), (503, "long one with many words\n" * 3000), (504, "long one with many words\n" * 2999)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA).repartition(3)
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    want = slow(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] == want[i, t], i
    digest = {r.doc_id: r for r in ld.line_digest(df).collect()}
    import hashlib

    assert all(digest[i].kept_sha256 == hashlib.sha256((got[i] or "").encode()).hexdigest() for i, _ in docs)


def test_patience():
    later = {0: 1, 1: 2, 2: 3, 3: 9, 5: 4, 6: 4}
    earlier = {0: 9, 1: 1, 2: 2, 3: 3, 8: 4, 9: 4}
    assert ld.patience(later, earlier) == [(0, 1), (1, 2), (2, 3), (5, 8), (6, 9)]
    assert ld.common_blocks(later, earlier, dict.fromkeys(later, 2), 5) == [0, 1, 2]
    assert ld.common_blocks({0: 1, 1: 2, 4: 1, 5: 2, 9: 1, 11: 2}, {3: 1, 4: 2}, dict.fromkeys(range(12), 3), 5) == [0, 1, 4, 5]
    many = ld.common_blocks(dict.fromkeys(range(200_000), 7), {3: 7}, dict.fromkeys(range(200_000), 6), 5)
    assert many == list(range(200_000))
    assert ld.patience({}, {1: 1}) == []


def test_repeated_rows_and_null_ids(spark):
    text = "the same five words here\nand another line of five words"
    df = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0), (2, text, "", 0), (None, text, "", 0), (3, "unrelated words stay as they are", "", 0)], SCHEMA)
    got = sorted((str(r.doc_id), r.text) for r in ld.dedup_lines(df).collect())
    assert got == [("1", text), ("1", text), ("2", ""), ("3", "unrelated words stay as they are"), ("None", "")]
    assert ld.dedup_lines(df.limit(0)).count() == 0 and ld.line_digest(df.limit(0)).count() == 0


def test_many_rows_in_one_batch(spark):
    docs = [(i, f"line {i} of words that nobody else has\nsecond {i} line", "c", i) for i in range(700)] + [(1000 + i, f"line {i} of words that nobody else has\nother {i}", "c", i) for i in range(300)]
    got = {r.doc_id: (r.text, r.first) for r in ld.dedup_lines(spark.createDataFrame(docs, SCHEMA).coalesce(1)).collect()}
    assert all(got[i] == (f"line {i} of words that nobody else has\nsecond {i} line", i) for i in range(700))
    assert all(got[1000 + i] == (f"other {i}", i) for i in range(300))


def test_longest_common_is_exact(monkeypatch):
    rng = random.Random(4)
    for bits in (1 << 27, 8):
        monkeypatch.setattr(ld, "LCS_BITS", bits)
        for _ in range(150):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            got = ld.longest_common(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_refrains_and_line_ends(spark):
    r, s = "the refrain has five words", "the second has five words"
    docs = [(1, "\n".join([s, r, s, r])), (2, "\n".join([r, s, r, s, r, s])), (3, "a line with a return\r\nand one more of words\t"), (4, "own\na line with a return\n and one more of words")]
    got = {x.doc_id: x.text for x in ld.dedup_lines(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA)).collect()}
    # a block serves all its repeats in a later document, so the third refrain goes with the other two
    assert got[1] == docs[0][1] and got[2] == ""
    assert got[3] == docs[2][1] and got[4] == "own"


def test_more_holders_lose_the_same(spark):
    """A passage of short lines, one of which an earlier document holds alone, goes however many hold it."""
    passage = ["one two three", "four five six", "seven eight nine"]
    for holders in (2, 4, 8, 40):
        docs = [(0, f"own start here\n{passage[1]}")] + [(k, "\n".join([f"own {k} words", *passage, f"end {k} words"])) for k in range(1, holders + 1)]
        got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA)).collect()}
        assert got[0] == docs[0][1] and got[1] == docs[1][1]
        assert all(got[k] == f"own {k} words\nend {k} words" for k in range(2, holders + 1))


def test_repeats_go_however_many_hold_them(spark):
    line = "one line of seven words for all"
    two, three = f"own two here\n{line}\nmid two\n{line}", f"{line}\nown three here\n{line}"
    for docs in ([(2, two), (3, three)], [(1, line), (2, two), (3, three)], [(0, line + "\nx"), (1, line), (2, two), (3, three)]):
        got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA)).collect()}
        assert got[3] == "own three here" and got == {i: slow(docs)[i, t] for i, t in docs}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_inside_documents_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [f"passage number {k} of five" for k in range(12)]
    docs = []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(3)]
        for x in rng.sample(pool, rng.randrange(4)):
            for _ in range(rng.choice([1, 1, 2, 3])):
                lines.insert(rng.randrange(len(lines) + 1), x)
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA).repartition(3)).collect()}
    want = slow(docs)
    count = lambda i, text: [text.split("\n").count(x) for x in pool]
    assert all(count(i, got[i]) == count(i, want[i, t]) for i, t in docs)


def test_moved_blocks_go(spark):
    a, b = "the first block has words", "the other block has words too"
    docs = [(1, f"{b}\nx\n{a}"), (2, f"{a}\ny\n{b}"), (3, f"{a}\nz\n{b}")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], SCHEMA)).collect()}
    assert got == {1: docs[0][1], 2: "y", 3: "z"}


def test_runs_cover_every_block():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.randrange(1, 8) for _ in range(rng.randrange(12))]
        starts, sizes = ld.line_runs(np.array(words, int))
        runs = [(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist())]
        assert all(sum(words[s:e]) >= 5 and e - s <= 5 for s, e in runs)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if sum(words[i:j]) >= 5:
                    covered = {p for s, e in runs if i <= s and e <= j for p in range(s, e)}
                    assert covered == set(range(i, j))


def test_hot_passage_is_split(spark):
    """Holders of one line are dealt to several tasks; the first holder stays whole."""
    rows = spark.range(4000).selectExpr("id as doc_id", "concat('own line number ', id, ' of this one\nthe licence line that all documents hold') as text", "'c' as class", "1 as first")
    got = ld.line_digest(rows).groupBy("n_removed").count().collect()
    assert sorted((r.n_removed, r["count"]) for r in got) == [(0, 1), (1, 3999)]


def test_clashing_columns(spark):
    rows = [(i, "a line that is shared by all\nown line of document number %d" % i, i, i, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, class int, _piece int, n int")
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((r._row, r["class"], r._piece, r.n, len(r.text.split("\n"))) for r in out.collect()) == [(i, i, i, i, 2 if i == 0 else 1) for i in range(4)]
