import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from corvane.llm.shared import scope
from test_near import brute_force


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", None, "s", 0)], docs.schema)
    found = [docs.union(odd)]
    for name, function in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.stage(function(spark, found[-1], sf_dir), "test-" + name.replace(" ", "-")))
    return found


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and set(steps[0].columns) < set(steps[-1].columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources", "BPE"]


def test_language_stage_keeps_clean_documents(steps):
    lost = steps[0].join(steps[1], "doc_id", "left_anti")
    assert sorted(r.doc_id for r in lost.collect()) == [10**6, 10**6 + 1, 10**6 + 2]


def test_exact_stage(steps):
    norm = F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), 256)
    expected = {r.k for r in steps[1].groupBy(norm).agg(F.min("doc_id").alias("k")).collect()}
    assert {r.doc_id for r in steps[2].collect()} == expected and steps[2].count() == len(expected)


def test_near_stage_equals_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {i for i, (_, c) in brute_force(rows, 5).items() if i == c}


def test_mix_and_tokens(steps):
    kept = {r.doc_id: r for r in steps[3].collect()}
    mixed = steps[4].collect()
    assert {r.doc_id for r in mixed} <= set(kept) and abs(len(mixed) - len(kept)) < 6 * len(kept) ** 0.5
    assert all(r == kept[r.doc_id] for r in mixed)
    out = steps[5].collect()
    assert len(out) == len(mixed)
    assert all(r.n_tokens == len(r.token_ids) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in out)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "empty-" + name.replace(" ", "-"))
        assert docs.count() == 0


def test_run_leaves_one_table_and_no_others_lose_theirs(spark, sf_dir):
    with scope(spark) as others, scope(spark) as own:
        mine = corpus_pipeline.stage(spark.range(3).toDF("x"), "test-other")
        own.paths.clear()
        out = corpus_pipeline.run(spark, sf_dir)
        assert len(own.paths) == 1 and own.paths[0].rpartition("/")[2].startswith("pipeline-BPE")
        assert out.count() > 0 and mine.count() == 3 and others.paths
