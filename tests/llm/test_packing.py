import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ashlar.llm import packing

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.Tokenizer()
ODD = ["", " ", "a  b", "a\nb c", "a \nb", "x <|endoftext|> y", "it's we'll 12 b3 ,. ;:'re", "　a\x85b", "🎉 🎉🎉 a", "é ü ß 日本 語", "\x00\x1c"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert np.frombuffer(FAST.ids(text), "<u4").tolist() == SLOW.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert np.frombuffer(FAST.ids(text), "<u4").tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_cuts_meet_class_lengths():
    lengths = np.array(packing.class_lengths())
    for total in [*range(1, 5000), 123_457]:
        cut = packing.cut_lengths(total, lengths)
        assert sum(cut) == total and set(cut) <= set(lengths.tolist())


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    texts = [(i, " ".join(f"word{j * i}" for j in range(i % 50 * i % 97))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "long text " * 9000), (None, "no id"), (1, "word again"), (1, "word again")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, length int, worker string").repartition(5)
    rows = packing.pack(df, capacity, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = bytes(r.ids)
        assert len(ids) == 4 * r.length and zlib.crc32(ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(SLOW.encode(t or "", add_special_tokens=False).ids + [1])
    for i, docs in want.items():
        parts = sorted(by_doc[i])
        assert sum(len(p) for _, p, _ in parts) // 4 == sum(map(len, docs))
        if len(docs) == 1:
            assert np.frombuffer(b"".join(p for _, p, _ in parts), "<u4").tolist() == docs[0]
            assert {n for *_, n in parts} == {len(docs[0])}
            assert [s for s, *_ in parts] == np.cumsum([0] + [len(p) // 4 for _, p, _ in parts[:-1]]).tolist()
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) * capacity <= 1.03 * total + 3 * capacity
    again = packing.pack(df, capacity).count()
    assert again == len(rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "a", "　", " \n"])
def test_ids_of_a_million_of_one_character(unit):
    text = "start " + unit * (1_000_000 // len(unit)) + " end"
    assert FAST.ids(text) == np.array(SLOW.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
