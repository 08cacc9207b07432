import corpus_pipeline
from tests.llm.conftest import SMALL
from trellis.llm import queries
from trellis.llm.common import materialize, scratch, settled
from tests.llm.test_decontam import brute as decontam_brute
from trellis.llm.simhash import fingerprint


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == columns, name
        old, new = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert new <= old and new
        if name == "line dedup":
            assert new == old
        if name == "benchmark decontamination":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert new == {d for d, t in texts.items() if not decontam_brute(t, bench)[1]}
        if name == "simhash near-dedup":
            fps = [fingerprint(r.text.encode()) & (2**64 - 1) for r in after.collect()]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
        before = after
    left = {r.doc_id for r in before.collect()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == left
    seqs = {}
    for r in pieces:
        seqs[r.sequence_id] = seqs.get(r.sequence_id, 0) + r.length
    assert max(seqs.values()) <= 1024


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() >= 0


def test_results_of_all_operators_outlive_a_pipeline_run(spark):
    """A run deletes what it wrote itself, and nothing that other results still read."""
    made = {name: q(spark, SMALL) for name, q in queries.QUERIES.items()}
    assert corpus_pipeline.run(spark, SMALL).count()
    for name, df in made.items():
        assert df.count(), name


def test_scopes_own_their_tables(spark):
    import os

    there = lambda df: os.path.exists(df._trellis_path.removeprefix("file://"))
    outside = materialize(spark.range(3).toDF("x"), "outside")
    with scratch() as own:
        gone, kept = materialize(outside, "gone"), materialize(outside, "kept")
        own.keep(kept)
    done = settled(lambda: materialize(materialize(kept, "inner"), "result").where("x > 0"), "settled")
    assert there(outside) and there(kept) and there(done) and not there(gone)
    assert done.count() == 2 and kept.count() == 3
    with scratch():
        with scratch() as inner:
            passed = materialize(outside, "passed")
            inner.keep(passed)
        assert there(passed)
    assert not there(passed)
