"""The numpy kernel against plain arithmetic, and exact quantiles against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftquarry.functions import arrow_kernel, kernel
from driftquarry.operators import aggregate, score, sweep
from driftquarry.plans import kernel_queries


def truncated(p_logits, q_logits, k):
    """Divergence of q from p's stored head with an even tail, id by id."""
    lse = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    ids = sorted(range(len(p_logits)), key=lambda i: (-p_logits[i], i))[:k]
    lp = arrow_kernel.bf16(p_logits[ids] - lse(p_logits))
    head = min(np.log(np.exp(lp).sum()), kernel.HEAD_CAP)
    full = np.full(len(p_logits), np.log(1 - np.exp(head)) - np.log(len(p_logits) - k))
    full[ids] = lp
    return ids, float((np.exp(full) * (full - (q_logits - lse(q_logits)))).sum())


@pytest.mark.parametrize("vocab,k", [(40, 7), (3000, 50), (3000, 2500)])
def test_scores_id_by_id(spark, vocab, k):
    rng = np.random.default_rng(vocab + k)
    p = np.round(rng.normal(0, 3, (12, vocab)), 1)  # many ties
    q = p + rng.normal(0, 0.3, (12, vocab))
    shape = "seq_id int, pos int, token_id int, attn boolean, logits array<double>"
    teacher = spark.createDataFrame([(0, i, i, True, x.tolist()) for i, x in enumerate(p)], shape)
    student = spark.createDataFrame([("s", 0, i, x.tolist()) for i, x in enumerate(q)], "student string, seq_id int, pos int, logits array<double>")
    heads = arrow_kernel.teacher_topk(teacher, k)
    got = score.score_student(heads, student).orderBy("pos").collect()
    floor = heads.orderBy("pos").collect()
    for i in range(12):
        ids, want = truncated(p[i], q[i], k)
        assert floor[i]["topk_idx"] == ids
        assert got[i]["kld"] == pytest.approx(want, abs=1e-9)
        assert floor[i]["floor_kld"] == pytest.approx(truncated(p[i], p[i], k)[1], abs=1e-9)
        assert got[i]["top1"] == (int(q[i].argmax()) == ids[0])
        assert got[i]["top5"] == (ids[0] in sorted(range(vocab), key=lambda j: (-q[i][j], j))[:5])
    sums = sweep.floor_sweep(teacher, [k, 5], vocab).orderBy("k").collect()
    for row in sums:
        assert row["mean_floor"] == pytest.approx(np.mean([max(truncated(x, x, row["k"])[1], 0) for x in p]), abs=1e-9)


def test_rows_without_logits_and_of_other_widths(spark):
    shape = "seq_id int, pos int, token_id int, attn boolean, logits array<double>"
    rows = [(0, 0, 1, True, [1.0, 2.0, 3.0]), (0, 1, 1, True, None), (0, 2, 0, True, [5.0, 1.0, 2.0, 4.0]), (0, 3, 0, True, [])]
    heads = arrow_kernel.teacher_topk(spark.createDataFrame(rows, shape), 2)
    got = {r["pos"]: r for r in heads.collect()}
    assert got[0]["topk_idx"] == [2, 1] and got[2]["topk_idx"] == [0, 3]
    assert got[1]["topk_idx"] is None and got[1]["floor_kld"] is None and got[3]["topk_logp"] is None
    students = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "seq_id int, pos int, logits array<double>")
    facts = {r["pos"]: r for r in score.score_student(heads, students).collect()}
    assert facts[0]["kld"] == pytest.approx(facts[0]["floor_kld"]) and facts[1]["kld"] is None and facts[1]["top1"] is None
    assert arrow_kernel.teacher_topk(spark.createDataFrame([], shape), 2).collect() == []
    with pytest.raises(ValueError):
        sweep.floor_sweep(students, [0, 9], 3)


def test_heads_as_wide_as_the_vocabulary_are_an_error(spark):
    heads = spark.createDataFrame([(0, 0, 0, True, [0, 1], [-0.7, -0.7], 0.0)], "seq_id int, pos int, token_id int, attn boolean, topk_idx array<int>, topk_logp array<double>, floor_kld double")
    students = spark.createDataFrame([(0, 0, [0.0, 0.0])], "seq_id int, pos int, logits array<double>")
    with pytest.raises(Exception, match="smaller than the vocabulary"):
        score.score_student(heads, students).collect()


def test_wide_vocabulary_by_brute_force(spark, sf_dir):
    row = kernel_queries.k7_wide(spark, sf_dir).where("seq_id = 3 AND pos = 1").first()
    one = lambda bits: np.array(kernel_queries._wide(spark, sf_dir, bits).where("seq_id = 3 AND pos = 1").first()["logits"])
    p, q = one(0), one(8)
    assert row["kld"] == pytest.approx(truncated(p, q, 4096)[1], abs=2e-6)
    assert row["floor_kld"] == pytest.approx(truncated(p, p, 4096)[1], abs=2e-6)


@pytest.mark.parametrize("fine", [1 << 16, 3])
def test_quantiles_are_numpys(spark, monkeypatch, fine):
    monkeypatch.setattr(aggregate, "FINE", fine)
    rng = np.random.default_rng(fine)
    groups = {"a": rng.lognormal(-3, 2, 500), "b": np.zeros(40), "c": np.array([1e-300, 5.0]), "d": np.array([7.0]), "e": np.concatenate([np.zeros(300), rng.uniform(0.999, 1.0, 200), [1e300]])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {r["g"]: r["q_"] for r in aggregate.quantiles(df, "v", shares, ("g",)).collect()}
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, shares), rel=1e-12), g
    everything = np.concatenate(list(groups.values()))
    assert aggregate.quantiles(df, "v", shares).first()["q_"] == pytest.approx(np.quantile(everything, shares), rel=1e-12)
    assert aggregate.quantiles(df.where("v < 0"), "v", shares, ("g",)).collect() == []


def test_histogram_bins_against_a_linear_search(spark):
    x = [0.0, *aggregate.EDGES[1:-1], *[e * 0.999999 for e in aggregate.EDGES[1:-1]], 50.0]
    got = [r["b"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", aggregate.histogram_bin("v").alias("b")).orderBy("i").collect()]
    assert got == [sum(v >= e for e in aggregate.EDGES[1:-1]) for v in x]
    facts = spark.createDataFrame([("s", 0.5), ("s", float("nan")), ("t", None)], "student string, kld double")
    bins = aggregate.histogram(facts, ("student",)).groupBy("student").agg(F.count("*").alias("bins"), F.sum("n").alias("n")).collect()
    assert {tuple(r) for r in bins} == {("s", 30, 1), ("t", 30, 0)}
