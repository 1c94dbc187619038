import os

import pytest

SF = os.environ.get("MILLRACE_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from millrace.llm.divide_skip_join import groups
    from millrace.llm.shared import read_table, stage_table
    from millrace.llm.template_decontamination import leaks

    docs = read_table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage_table(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns, name
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[-1] > 0.6 * sizes[0]
    assert groups(docs).where("doc_id <> component_id").count() == 0
    assert leaks(docs, read_table(spark, SF, "benchmark")).count() == 0
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and done.count() == sizes[-1]
