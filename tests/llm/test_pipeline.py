"""The pipeline stage by stage against what each operator says of its input."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from copperbook.llm import decontamination, queries, secrets, simhash, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = stage(spark, docs, sf_dir).cache()
    return [*kept, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.score(stages[0], toxicity.train(stages[0], labels))
    assert ids(stages[1]) == ids(scores.where("predicted = 0"))


def test_one_of_each_group_stays(stages):
    found = simhash.near_duplicates(stages[1])
    assert ids(stages[2]) == sorted({r["component_id"] for r in found.collect()})
    assert stages[2].select("text").distinct().count() == stages[2].count()


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = {r["doc_id"] for r in decontamination.matches(stages[2], items).collect()}
    assert ids(stages[3]) == [d for d in ids(stages[2]) if d not in hits] and hits


def test_secrets_are_masked(stages):
    assert ids(stages[4]) == ids(stages[3])
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(stages[3]).collect()}
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert ("[secret]" in r["text"]) == bool(spans[r["doc_id"]])
        assert spans[r["doc_id"]] or r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert all(r["n_assign"] + r["n_access"] + r["n_hex"] == 0 for r in secrets.scan(stages[4]).collect())


def test_packing_loses_no_word(stages):
    words = sum(len((r["text"] or "").split()) for r in stages[4].collect())
    assert sum(r["n_tokens"] for r in stages[5].collect()) == words


def test_whole_run(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[5])


def test_odd_documents(spark, sf_dir, stages):
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh"], k=300))
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, "x", None, "s", None)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
        frame.collect()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_sql(spark, duck, sf_dir):
    for name, sql in queries.ORACLES.items():
        result = queries.QUERIES[name](spark, sf_dir)
        wanted = duck.execute(sql)
        columns = [d[0] for d in wanted.description]
        assert sorted(columns) == sorted(result.columns)
        assert sorted(tuple(r[c] for c in columns) for r in result.collect()) == sorted(wanted.fetchall())


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op4_quality_rules", "op5_sharding", "op9_secret_scan"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
