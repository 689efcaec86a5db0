"""The pipeline against brute force: each stage on what its predecessor kept."""

import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ashlar.llm import mixing, toxicity
from ashlar.llm.common import staged
from tests.llm import test_line_dedup, test_mixing, test_shingles

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    machine = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.toxic_scores(docs, machine).where("predicted = 1").collect()}
    kept = staged(stages[0](spark, docs, SF), "t-toxicity")
    before = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == columns and set(before) == {r.doc_id for r in docs.collect()} - rejected

    cut = staged(stages[1](spark, kept, SF), "t-lines")
    want = test_line_dedup.slow(list(before.items()))
    after = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == columns and all(after[i] == want[i, t] for i, t in before.items())

    once = staged(stages[2](spark, cut, SF), "t-once")
    groups = test_shingles.slow([(i, t, 0) for i, t in after.items()])
    left = {r.doc_id: r for r in once.collect()}
    assert once.columns == columns and set(left) == set(groups.values()) and all(left[i].text == after[i] for i in left)

    mixed = staged(stages[3](spark, once, SF), "t-mixed")
    sizes = {}
    for r in left.values():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = test_mixing.filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = {}
    rows = mixed.collect()
    for r in rows:
        assert (left[r.doc_id].text or "").startswith((r.text or "").rstrip()[:1]) and (left[r.doc_id].text or "").find(r.text or "") == 0
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    assert mixed.columns == columns and all(abs(taken.get(s, 0) - target[s]) <= 0.5 for s in sizes)

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages[4](spark, mixed, SF).collect()
    assert sum(r.length for r in packed) == sum(len(slow.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_tables_pass_every_stage(spark):
    """An empty corpus, extra columns with clashing names, nulls and repeated ids: no stage fails or loses a text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, node long, _row string, n int"
    texts = [None, "", "short", "a clean text of some words that is like no other one here", "another text that has nothing in common with the rest of it"]
    rows = [(i % 4, t, "en", None if i % 2 else "s", 1, i, i, "x", i) for i, t in enumerate([*texts, texts[3]])]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = staged(stage(spark, docs, SF), f"odd-{name}")
            if name != "packing":
                assert docs.columns == before.columns
            if name == "simhash_near_dedup" and data:
                assert {texts[3], texts[4]} <= {r.text for r in docs.collect()}
        assert (docs.count() > 0) == bool(data)
