import corpus_pipeline

from quire.llm import langid, packing, quality
from quire.llm.common import table
from tests.llm.test_corpus_operators import ODD, ODD_SCHEMA, brute_groups

DIR = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    """Stage by stage, each on what its predecessor kept; near-duplicates by all pairs of five-word shingle sets."""
    docs = table(spark, DIR, "documents")
    kept = {r.doc_id for r in quality.query(spark, docs).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(list(kept)))
    known = {r.doc_id for r in langid.query(spark, left).where(f"lang_pred <> 'und' and score >= {langid.KEEP_SCORE}").collect()}
    rows = sorted(left.where(left.doc_id.isin(list(known))).collect(), key=lambda r: r.doc_id)
    first = {rows[g].doc_id for g in brute_groups([r.text for r in rows])}
    got = corpus_pipeline.run(spark, DIR).collect()
    assert 0 < len(first) < len(known) <= len(kept)
    assert {r.doc_id for r in got} == first
    assert len(corpus_pipeline.STAGES) == 4 and sum(r.piece == 0 for r in got) == len(first)
    sent = packing.query(spark, docs.where(docs.doc_id.isin(list(first)))).collect()
    digest = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert digest(got) == digest(sent)


def test_odd_and_empty_tables_go_through(spark, tmp_path):
    """Nulls, empties, ties, repeats and clashing columns; all but the last stage return the columns of documents."""
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    for name, docs in (("odd", odd), ("empty", odd.limit(0)), ("blank", odd.where("doc_id in (1, 2, 3)"))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        step = docs
        for _, f in corpus_pipeline.STAGES[:-1]:
            step = f(spark, step, folder)
            assert step.columns == docs.columns
        assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= {r.doc_id for r in docs.collect()}
