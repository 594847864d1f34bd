import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import dataset, profiles, runs


@pytest.mark.parametrize(("n", "size", "test"), [(25, 0.1, 3), (10, 0.2, 2), (7, 0.0, 0), (5, 1.0, 5), (0, 0.1, 0)])
def test_split_is_exact(spark, n, size, test):
    counts = {r["split"]: r["count"] for r in dataset.train_test_split(spark.range(n), "id", size).groupBy("split").count().collect()}
    assert counts.get("test", 0) == test == math.ceil(round(size * n, 9)) and sum(counts.values()) == n


def test_split_does_not_depend_on_partitions(spark):
    one = dataset.train_test_split(spark.range(500).repartition(7), "id", 0.1)
    two = dataset.train_test_split(spark.range(500).coalesce(1), "id", 0.1)
    other = dataset.train_test_split(spark.range(500), "id", 0.1, seed=1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(two) != rows(other)


def test_split_narrows_down_large_tables(spark):
    hashed = spark.range(5000).select(F.struct(dataset.split_key(F.col("id"), 1).alias("h"), F.col("id").alias("k")).alias("o"))
    rows = sorted(tuple(r.o) for r in hashed.collect())
    for k in (1, 17, 2500, 5000):
        assert tuple(dataset._kth(hashed, k, at_once=10)) == rows[k - 1]


def test_instruct_format(spark):
    turns = [(1, 0, "user", " A "), (1, 1, "assistant", "B"), (1, 2, "user", "C"), (2, 0, "system", "S"), (2, 1, "user", None)]
    got = {r.conv_id: r.text for r in dataset.instruct_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "</s>").collect()}
    assert got[1].endswith("    ### Instruction:\n    C\n\n    ### Input:\n    \n\n    ### Response:\n    B</s>")
    assert "### Input:\n    S" in got[2] and "### Instruction:\n    \n" in got[2]


def test_pages(spark):
    pages = spark.createDataFrame([("a", 2, " y "), ("a", 1, "x\n"), ("a", 3, None), ("b", 1, "")], "path string, page_no int, text string")
    got = {r.path: r.text for r in dataset.joined_pages(pages, "path", "page_no").collect()}
    assert got == {"a": "<<<PAGE 1>>>\nx\n\n\n<<<PAGE 2>>>\ny\n\n\n<<<PAGE 3>>>", "b": "<<<PAGE 1>>>"}
    assert {r.path: r.text for r in dataset.text_of_pages(pages, "path", "page_no").collect()} == {"a": "x y"}


def test_resume_and_head(spark):
    done = spark.createDataFrame([(1,), (1,), (3,)], "id long")
    assert sorted(r.id for r in dataset.not_done(spark.range(5), done, "id").collect()) == [0, 2, 4]
    assert [r.id for r in dataset.head(spark.range(9), 2, "id").collect()] == [0, 1]
    assert dataset.head(spark.range(9), 0, "id").count() == 0
    with pytest.raises(ValueError):
        dataset.head(spark.range(9), -1, "id")


def test_runs(spark, tmp_path):
    assert runs.checkpoint_of("qwen3-14b").startswith("unsloth/")
    with pytest.raises(ValueError):
        runs.checkpoint_of("nothing")
    assert len(runs.MODELS) == 9 and len(profiles.names()) == 9 and runs.profile_table(spark).count() == 233
    assert profiles.profile("cpt-mistral-7b-v03")["Additional"] == {} and "target_modules" not in profiles.profile("cpt-gemma-3-1b-pt-unsloth-bnb-4bit")["PEFTParams"]
    with pytest.raises(ValueError):
        profiles.profile("nothing")
    (tmp_path / "p.yaml").write_text("ModelConfig:\n  max_seq_length: 2048\n  dtype: null\n")
    assert profiles.load_profile(str(tmp_path / "p.yaml")) == {"ModelConfig": {"max_seq_length": 2048, "dtype": None}, "UnslothTrainingArguments": {}, "PEFTParams": {}, "Additional": {}}
    runs.log_run(spark, str(tmp_path / "runs"), "e", "r", {"a": 1, "b": None})
    runs.log_run(spark, str(tmp_path / "runs"), "e", "r2", {"a": 2})
    assert sorted((r.run, r.key, r.value) for r in runs.read_runs(spark, str(tmp_path / "runs")).collect()) == [("r", "a", "1"), ("r", "b", None), ("r2", "a", "2")]
    assert runs.run_report(2 * 1024**3, 1024**3, 90) == {"train_runtime_min": 1.5, "peak_reserved_memory": 2.0, "peak_reserver_memory_training": 1.0}
    assert runs.health()["pyspark"]


def test_split_of_null_and_repeated_keys(spark):
    rows = [(None, k) for k in range(5)] + [("a", k) for k in range(30)] + [(f"k{k}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "key string, n int")
    for parts in (1, 5):
        got = dataset.train_test_split(df.repartition(parts), "key", 0.2).collect()
        assert len(got) == len(rows) and all(len({r.split for r in got if r.key == k}) == 1 for k in (None, "a"))
        tests = sum(r.split == "test" for r in got)
        assert 27 <= tests <= 27 + 29
    for key in (None, ""):
        only = spark.createDataFrame([(key,)] * 3, "key string")
        assert {r.split for r in dataset.train_test_split(only, "key", 0.1).collect()} == {"test"}
    numbers = spark.createDataFrame([(None,), *((k,) for k in range(99))], "key long")
    assert dataset.train_test_split(numbers, "key", 0.1).filter("split = 'test'").count() == 10


def test_experiments_are_made_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: runs.experiment_id(spark, str(tmp_path), "CPT-x"), range(16)))
    assert len({i for i, _ in found}) == 1 and any(made for _, made in found)
    assert [p.read_text() for p in (tmp_path / "_experiments").iterdir() if not p.name.startswith(".")] == ["CPT-x"]
    other, made = runs.experiment_id(spark, str(tmp_path), "CPT-y")
    assert made and other != found[0][0] and runs.experiment_id(spark, str(tmp_path) + "/", "CPT-y") == (other, False)
    runs.log_run(spark, str(tmp_path), "CPT-z", "r", {"a": 1})
    assert not runs.experiment_id(spark, str(tmp_path), "CPT-z")[1] and runs.read_runs(spark, str(tmp_path)).count() == 1


def test_settings_of_unknown_models(spark):
    df = spark.createDataFrame([(1, "gemma-3-1b"), (2, "?"), (3, None)], "id int, alias string")
    got = runs.settings_for_models(df, "alias").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 29, 2: 1, 3: 1}
