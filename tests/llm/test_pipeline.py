import brute
import corpus_pipeline
from tracklake.llm import classifier, simhash
from tracklake.llm.common import staged


def test_stages_judge_their_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), name)
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after = {r.doc_id: (r.text if "text" in out.columns else None) for r in out.collect()}
        assert set(after) <= set(before) and (name == "piece_encoding" or out.columns == columns)
        if name == "quality_classifier":
            verdict = {r.doc_id: r.predicted for r in classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert set(after) == {d for d in before if verdict[d]}
        if name == "line_dedup":
            assert all(len(after[d]) <= len(before[d] or "") for d in after if after[d] is not None)
            assert all(not before[d].strip() or d in after or "\n" in before[d] for d in before)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            roots = brute.components([brute.fingerprint(before[d]) for d in ids])
            assert set(after) == {ids[r] for r in roots}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in brute.benchmark_hits(list(before.items()), items) if not r[5]}
        if name == "piece_encoding":
            assert set(after) == set(before)
        seen.append(name)
        docs = out
    assert len(seen) == 5
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in docs.collect())
    assert simhash.op3_simhash
