"""The pipeline's stages on what the stage before kept: near duplicates and decontamination against brute
force, toxicity against its operator's predictions, masking and packing by their invariants."""

import corpus_pipeline as C
from tessera.llm import toxicity as X
from tessera.llm.common import read, without_ids, written
from tests.llm import tables
from tests.llm.test_decontaminate import brute
from tests.llm.test_jaccard_join import brute_force

SF = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in X.toxicity_scores(docs, read(spark, SF, "labels")).collect()}
    kept = []
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF))
        kept.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    got = {name: {r.doc_id: r for r in df.collect()} for name, df in kept[:-1]}
    assert set(got["toxicity"]) == {d for d, p in scores.items() if not p}
    groups = brute_force((d, rows[d].text) for d in got["toxicity"])
    assert set(got["near_duplicates"]) == {c for _, c in groups.values()}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = {d for d in got["near_duplicates"] if not brute(rows[d].text, items)[1]}
    assert set(got["decontamination"]) == clean
    assert set(got["secrets"]) == clean
    changed = [d for d in clean if got["secrets"][d].text != rows[d].text]
    assert all("[SECRET]" in got["secrets"][d].text for d in changed)
    tokens = {d: len(got["secrets"][d].text.split()) for d in clean}
    packed = {}
    for r in kept[-1][1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == tokens


def test_run_equals_stages(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(C.STAGES) == 5


def test_awkward_rows(spark, tmp_path):
    tables.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    tables.labels(spark, [(1, 1, 0), (2, 0, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, tables.prose(25, 3))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} >= {1, 4, 8} and 10 not in {r.doc_id for r in packed}


def test_without_ids(spark):
    df = spark.range(2000).selectExpr("if(id % 100 = 7, null, id) k", "id v").union(spark.sql("select 5L, 99999L"))
    gone, once = spark.range(0, 2000, 3).toDF("k"), spark.sql("select 5L k")
    got = [(r.k, r.v) for r in without_ids(df, "k", gone, once).collect()]
    assert sum(k is None for k, _ in got) == 20
    assert sorted(k for k, _ in got if k is not None) == [i for i in range(2000) if i % 3 and i % 100 != 7]
