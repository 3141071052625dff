import corpus_pipeline
import voxledger.llm.queries  # noqa: F401
from voxledger.plans.registry import QUERIES


def test_stages_keep_columns_and_take_effect(spark, messy, empty):
    folder = "/root/testdata/sf0.001"
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == messy.columns, name
            assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.near_copies(spark, messy, folder).count() < messy.count()
    last = corpus_pipeline.STAGES[-1][1](spark, messy, folder)
    assert last.count() == messy.count() and "doc_id" in last.columns


def test_the_whole_run(spark):
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert 0 < len(got) < len(docs) and len({r.doc_id for r in got}) == len(got)
    for r in got:
        kept, source = r.decoded.split("\n"), docs[r.doc_id].split("\n")
        place = iter(source)
        assert r.decoded == "" or all(line in place for line in kept)  # lines in their order
    leaks = {r.doc_id for r in QUERIES["op1_template_decontam"](spark, folder).collect()}
    assert not leaks & {r.doc_id for r in got}


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES
