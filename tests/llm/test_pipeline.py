"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from corpusloom.llm import base, decontaminate, queries, simhash


def test_stages(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, base.written(stage(spark, docs, sf_dir), name)
        kept[name] = (before, out)
        docs = out
        if name != "encoding":
            assert out.columns == before.columns and out.dtypes == before.dtypes
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, out = kept["quality"]
    scored = queries.op1_quality(spark, sf_dir).collect()
    assert ids(out) == sorted(r.doc_id for r in scored if r.predicted == 1)
    before, out = kept["near_duplicates"]
    assert ids(out) == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})
    before, out = kept["substrings"]
    assert set(ids(out)) <= set(ids(before)) and out.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").count()
    before, out = kept["decontamination"]
    items = [(str(r.item_id), r.text) for r in base.table(spark, sf_dir, "benchmark").collect()]
    bad = {r.doc_id for r in before.collect() if (f := decontaminate.brute_force(r.text, items))[1] and 20 * f[1] >= f[0]}
    assert ids(out) == sorted(set(ids(before)) - bad)
    before, out = kept["encoding"]
    assert ids(out) == ids(before)
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id: r.ids_sha256 for r in out.collect()}


def test_stages_on_odd_tables(spark, odd, nothing, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, nothing):
            out = stage(spark, docs, sf_dir)
            assert name == "encoding" or out.columns == docs.columns
            assert out.count() <= docs.count()
