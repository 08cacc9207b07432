import zlib

from trellis.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.fit_and_identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in own) >= 0.98 * len(own)


def test_labels_of_held_out_rows_play_no_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.selectExpr("doc_id", "text", "source", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    a, b = ({r.doc_id: tuple(r) for r in langid.fit_and_identify(d).collect()} for d in (docs, swapped))
    assert a == b


def test_edges(spark, edge_docs, no_docs):
    got = langid.fit_and_identify(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[3].lang_pred == langid.UNKNOWN and by[0].score == 0
    assert by[11].lang_pred == "en" and not by[None].held_out if None in by else True
    assert langid.fit_and_identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.fit_and_identify(edge_docs.withColumn("lang", edge_docs["key"].substr(9, 1))).collect()} <= {langid.UNKNOWN, ""}
