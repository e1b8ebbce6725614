import corpus_pipeline
from folioscope.llm import quality_gbdt
from folioscope.llm.common import table, written
from tests.llm.test_simhash_vp import components, slow_fingerprint
from tests.llm.test_substring_fm import brute

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, DIR, "documents")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        left[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == columns
    before, after = left["quality"]
    forest = quality_gbdt.train(spark.createDataFrame(before, table(spark, DIR, "documents").schema), table(spark, DIR, "labels"))
    good = {r["doc_id"] for r in before if forest.score(__import__("numpy").array([quality_gbdt.statistics(r["text"])]))[0] >= 0.5}
    assert {r["doc_id"] for r in after} == good
    before, after = left["near_duplicates"]
    before = sorted(before, key=lambda r: r["doc_id"])
    label = components([slow_fingerprint(r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {before[x]["doc_id"] for x in set(label)}
    before, after = left["substrings"]
    want = brute([(r["doc_id"], r["text"]) for r in before], 20)
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(texts) == len(before)
    for r in before:
        n, kept = want[r["doc_id"], r["text"]]
        assert texts[r["doc_id"]].split() == kept.split()
        if len(kept.split()) == n:
            assert texts[r["doc_id"]] == r["text"]
    before, after = left["benchmark"]
    items = [" ".join(r["text"].split()) for r in table(spark, DIR, "benchmark").collect()]
    planted = {r["doc_id"] for r in before if any(t in " ".join(r["text"].split()) for t in items)}
    assert planted and not planted & {r["doc_id"] for r in after}
    assert len(before) - len(after) <= len(planted) + 2
    before, after = left["tokens"]
    assert len(before) == len(after) and all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_empty_documents(spark):
    docs = table(spark, DIR, "documents").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        assert docs.count() == 0


def test_edges(spark, edge):
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        assert "_key" in docs.columns and docs.columns[:len(edge.columns)] == edge.columns
