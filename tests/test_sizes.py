"""Queries over tables of other sizes than the given ones: sequences cut short, several files, long texts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftquarry import api
from driftquarry.functions import arrow_kernel
from driftquarry.operators import score
from driftquarry.plans import base, kernel_queries, registry
from driftquarry.sources import corpus, files
from driftquarry.streaming import metrics

from .test_queries import rows


@pytest.fixture(scope="module")
def cut_short(spark, sf_dir, tmp_path_factory):
    """Embeddings whose last sequence has six positions, where all others have ten."""
    where = tmp_path_factory.mktemp("short")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 496").write.parquet(str(where / "embeddings.parquet"))
    return str(where)


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, folder)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_stream_hash_takes_sequences_of_any_length(spark):
    made = lambda *r: spark.createDataFrame(list(r), "seq_id int, tokens array<int>")
    assert corpus.stream_hash(made((2, [3]), (1, [1, 2]))) == corpus.stream_hash(made((0, [1, 2, 3]))) == corpus.stream_hash(made((1, []), (2, [1, 2, 3])))
    for bad in ([1, None], None):
        with pytest.raises(Exception, match="null"):
            corpus.stream_hash(made((1, [1]), (2, bad)))


@pytest.mark.parametrize("name", ["api2_score_students", "api4_errors", "c2_lifecycle", "c8_touch", "f15_witness", "f19_now", "sk2_shards"])
def test_last_sequence_is_shorter(spark, cut_short, name):
    equals_sql(spark, cut_short, name)


def test_failing_build_has_begun(spark, sf_dir, tmp_path, monkeypatch):
    """The lifecycle's last build fails while it writes, whichever row is read first: here one of the high ids."""
    all_ids, where = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), str(tmp_path / "embeddings.parquet")
    all_ids.where("vec_id > 300").coalesce(1).write.parquet(where)
    all_ids.where("vec_id < 100").coalesce(1).write.mode("append").parquet(where)
    assert base.logits(spark, str(tmp_path)).first()["vec_id"] > 300
    begun, write = [], files.write_entry
    monkeypatch.setattr(files, "write_entry", lambda *given: begun.append(given[2]) or write(*given))
    got = [r["status"] for r in registry.queries()["c2_lifecycle"](spark, str(tmp_path)).orderBy("step").collect()]
    assert got == ["MISS", "HIT", "REBUILD", "another tokenizer", "MISS", "removed after a failure"]
    assert len(begun) == 4 and len(set(begun)) == 2


def test_wide_logits_stay_in_the_worker(spark, sf_dir):
    """The wide query equals scoring of logits that are a column, without any such column: one Python pass, over inputs."""
    made = kernel_queries.k7_wide(spark, sf_dir)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1
    own = [kernel_queries._wide(spark, sf_dir, bits).where("seq_id < 3") for bits in (0, 8)]
    want = score.score_student(arrow_kernel.teacher_topk(own[0], 4096), own[1].drop("token_id", "attn"))
    want = want.select("seq_id", "pos", base.r8("kld", 6), "top1", "top5", base.r8("floor_kld", 6))
    got = [tuple(r) for r in made.where("seq_id < 3").collect()]
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) > 20


def test_made_scores_without_inputs_or_next_tokens(spark):
    """Rows without inputs have null scores, and shifts are those of score_student."""
    shape = "seq_id int, pos int, token_id int, attn boolean, teacher_input array<double>"
    inputs = [[1.0, 2.0, 3.0], None, [5.0, 1.0, 2.0], [], [0.0, 1.0, 0.5]]
    teacher = spark.createDataFrame([(0, i, i % 3, True, x) for i, x in enumerate(inputs)], shape)
    students = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(inputs)], "student string, seq_id int, pos int, student_input array<double>")
    got = score.score_made(teacher, students, 1, 3, (lambda x: x, lambda x: x * 0.5)).orderBy("pos").collect()
    half = students.select("student", "seq_id", "pos", F.transform("student_input", lambda x: x * 0.5).alias("logits"))
    want = score.score_student(arrow_kernel.teacher_topk(teacher.withColumnRenamed("teacher_input", "logits"), 1), half).orderBy("pos").collect()
    assert got == want and got[1]["kld"] is None and got[0]["delta_p"] is not None and got[4]["delta_p"] is None


def test_tokenizer_batches_are_bounded_in_bytes(spark):
    """A worker is given some long texts at a time, and ids come back whole, as nulls and empty lists too."""
    given = [(0, None), (1, ""), (2, "ab"), *[(i, "é" * 200_000) for i in range(3, 43)]]
    df = spark.createDataFrame(given, "id int, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r["id"]: r["t"] for r in df.select("id", api.tokenize_with(lambda t: [len(t)])("text").alias("t")).collect()}
    assert got[0] is None and got[1] == [0] and got[2] == [2] and got[42] == [200_000]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= api.TEXT_BYTES
    whole = {r["id"]: r["t"] for r in df.select("id", api.tokenize_with(lambda t: np.frombuffer(t.encode(), np.uint8))("text").alias("t")).collect()}
    assert whole[0] is None and whole[1] == [] and whole[2] == [97, 98] and whole[42] == [195, 169] * 200_000
    with pytest.raises(Exception, match="4294967296|too large|out of"):
        df.where("id = 2").select(api.tokenize_with(lambda t: [1 << 32])("text")).collect()


@pytest.mark.parametrize("name,source", [("st1_stream_ingest", "documents"), ("st3_online_metrics", "lineitem")])
def test_streams_are_staged_by_the_inputs_own_tasks(spark, sf_dir, tmp_path, monkeypatch, name, source):
    """Eight files are staged as eight, not gathered into four tasks however large they are; four batches take them all."""
    spark.read.parquet(f"{sf_dir}/{source}.parquet").repartition(8).write.parquet(str(tmp_path / f"{source}.parquet"))
    monkeypatch.setattr(metrics, "scratch", lambda spark: str(tmp_path / "stream"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert len(list((tmp_path / "stream" / "in").glob("part-*.parquet"))) == 8
    assert len(list((tmp_path / "stream").glob("*/batch=*"))) == 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{sf_dir}/{source}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert got and rows(names, got) == rows(names, want.fetchall())


def test_small_tables_are_staged_for_all_batches(spark, tmp_path):
    assert metrics.staged(spark.range(10, numPartitions=1).toDF("i"), str(tmp_path / "a")) == 1
    assert len(list((tmp_path / "a").glob("part-*.parquet"))) == 4
    assert metrics.staged(spark.range(10, numPartitions=9).toDF("i"), str(tmp_path / "b")) == 3
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10
