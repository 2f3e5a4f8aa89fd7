"""The pipeline's stages against brute force, and the registry's guard."""

import collections

import corpus_pipeline
from ledgerlens.llm import langid

from .test_corpus_operators import naive_components, naive_passages, naive_simhash

SF001 = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def stage(name, docs):
        out = stages[name](spark, docs, SF001)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    known = stage("language_id", docs)
    accepted = {r.doc_id for r in langid.identify(docs).collect() if r.accepted}
    assert {r.doc_id for r in known.collect()} == accepted and known.columns == columns

    single = stage("near_duplicates", known)
    groups = naive_components({r.doc_id: naive_simhash(r.text) for r in known.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted({min(g) for g in groups.values()})
    assert single.columns == columns

    clean = stage("repeated_passages", single)
    rows = single.collect()
    want = {r.doc_id: w.decode("utf-8", "ignore") for r, w in zip(rows, naive_passages([r.text.encode() for r in rows]))}
    assert {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect()) and clean.columns == columns

    mixed = stage("mixing_sources", clean)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += 1
    assert max(words.values()) <= 2 and set(words) <= set(want) and mixed.columns == columns
    total = sum(len(t.split()) for t in want.values())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) < 0.02 * total

    packed = stage("packing_sequences", mixed).collect()
    held = collections.Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096
    assert {r.doc_id for r in packed} == set(words)
    assert sum(r.piece == 0 for r in packed) == sum(words.values())


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() > 0 and "sequence_id" in out.columns
