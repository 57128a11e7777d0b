"""The pipeline against brute force."""

import corpus_pipeline
from panelspark.llm import rules
from tests.llm import brute
from tests.llm.conftest import DATA
from tests.llm.test_jaccard import survivors


def test_stages(spark, documents, labels, tmp_path):
    docs, seen = documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == documents.columns, name
        before, after = [(r["doc_id"], r["text"]) for r in docs.collect()], out.collect()
        ids = sorted(r["doc_id"] for r in after)
        if k == 0:
            keep = {r["doc_id"] for r in rules.judge(docs, labels).collect() if r["kept"]}
            assert ids == sorted(i for i, t in before if i in keep)
            assert not any(brute.counts(t)[1] for i, t in before if i in keep)
        elif k == 1:
            assert ids == sorted({x[1] for x in brute.exact(before)})
        elif k == 2:
            assert [(i is None, i or 0) for i in ids] == survivors(before)
        else:
            assert ids == sorted(i for i, _ in before)
        seen.append(len(after))
        docs = out
    assert all(r["round_trip"] for r in docs.collect())
    assert corpus_pipeline.run(spark, DATA).count() == seen[-1]
