"""Closed forms, published examples and invariances of the operators."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftquarry import api, cli
from driftquarry.functions import arrow_kernel, kernel, text
from driftquarry.operators import aggregate, cache_admin, measure, render, score, sweep
from driftquarry.sources import corpus, files

V, K = 64, 8


def circular(spark, shift=0, n=5, length=8):
    """Logits that peak at an id which depends on token and position, as the test model of the specification."""
    rows = []
    for i in range(n):
        for j in range(length):
            token = (i * length + j) % V
            d = np.abs((np.arange(V) - (7 * token + 3 * j + shift)) % V)
            d = np.minimum(d, V - d)
            rows.append((i, j, token, True, (-d * (0.30 + 0.10 * j + 0.07 * (token % 5))).tolist()))
    return spark.createDataFrame(rows, "seq_id int, pos int, token_id int, attn boolean, logits array<double>")


def scored(spark, shift=0, window=(4, 8)):
    teacher = arrow_kernel.teacher_topk(circular(spark), K)
    student = circular(spark, shift).select("seq_id", "pos", "logits")
    return score.score_student(teacher, student, window)


def test_fixture_varies(spark):
    peaks = circular(spark).select(kernel.argmax("logits").alias("a"), "pos").collect()
    assert len({r[0] for r in peaks}) > 10


def test_perfect_student_is_the_floor(spark):
    rows = scored(spark).collect()
    assert len(rows) == 20
    assert all(r["kld"] == pytest.approx(r["floor_kld"], abs=1e-12) and r["top1"] and r["top5"] for r in rows)


def test_drifted_student(spark):
    out = aggregate.scalars(scored(spark, 1)).first()
    assert out["top1"] == 0.0 and out["top5"] == 1.0 and out["mean"] > 2 * out["floor_mean"]


def test_windows_and_shifts(spark):
    assert scored(spark).where("delta_p IS NOT NULL").count() == 15
    inner = scored(spark, window=(2, 6))
    assert inner.count() == 20 and inner.where("delta_p IS NOT NULL").count() == 20
    buckets = aggregate.by_position(scored(spark), aggregate.Buckets(4, 8)).orderBy("bucket").collect()
    assert [(r["range"], r["tokens"]) for r in buckets] == [("4-5", 5), ("5-6", 5), ("6-7", 5), ("7-end", 5)]


def test_windows_add_up(spark):
    whole = scored(spark, 1, (2, 8)).agg(F.sum("kld"), F.count("*")).first()
    parts = [scored(spark, 1, w).agg(F.sum("kld"), F.count("*")).first() for w in ((2, 5), (5, 8))]
    assert whole[1] == sum(p[1] for p in parts) and whole[0] == pytest.approx(sum(p[0] for p in parts))


def test_partitions_do_not_matter(spark):
    a = aggregate.summarize(scored(spark, 1).withColumn("student", F.lit("s"))).first()
    b = aggregate.summarize(scored(spark, 1).withColumn("student", F.lit("s")).repartition(7)).first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_uniform_is_zero(spark):
    flat = spark.createDataFrame([(0, 0, 1, True, [0.0] * 1024)], "seq_id int, pos int, token_id int, attn boolean, logits array<double>")
    top = arrow_kernel.teacher_topk(flat, 16, rounded=False).first()
    assert abs(top["floor_kld"]) < 1e-4 and top["topk_idx"] == list(range(16))


def test_head_as_large_as_the_vocabulary(spark):
    assert len(arrow_kernel.teacher_topk(circular(spark), V).first()["topk_idx"]) == V - 1
    whole = kernel.with_lse(circular(spark)).withColumn("topk_idx", kernel.top_ids("logits", V)).withColumn("topk_logp", F.transform("topk_idx", lambda i: F.lit(-1.0)))
    with pytest.raises(Exception, match="smaller than the vocabulary"):
        kernel.with_kld(whole).collect()


def test_bf16(spark):
    x = np.concatenate([np.random.default_rng(1).normal(-5, 4, 2000), [0.0, -1.0, 1e-8, -3.0e5]])
    bits = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    want = (((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)
    got = [r[0] for r in spark.createDataFrame([(float(np.float32(v)),) for v in x], "x double").select(kernel.bf16("x")).collect()]
    assert np.array_equal(np.array(got, np.float32), want)


def test_vocabulary_alignment(spark):
    df = spark.createDataFrame([([0.0] * 12,)], "logits array<double>")
    row = kernel.align_vocab(df, 8).first()
    assert len(row["logits"]) == 8 and row["pad_mass"] == pytest.approx(4 / 12)
    with pytest.raises(Exception, match="narrower"):
        kernel.align_vocab(df, 20).collect()


def facts(spark, kld, seq=None, top1=True, delta=None, floor=0.001):
    n = len(kld)
    rows = [("s", seq[i] if seq else 0, i, float(kld[i]), top1, True, None if delta is None else delta[i] if i < len(delta) else None, floor[i] if isinstance(floor, list) else floor) for i in range(n)]
    return spark.createDataFrame(rows, "student string, seq_id int, pos int, kld double, top1 boolean, top5 boolean, delta_p double, floor_kld double")


def test_statistics_of_four_values(spark):
    out = aggregate.scalars(facts(spark, [0.1, 0.2, 0.3, 0.4], delta=[0.01, -0.03, 0.02])).first()
    dp = np.array([0.01, -0.03, 0.02])
    assert out["mean"] == pytest.approx(0.25) and out["iid_se"] == pytest.approx(np.std([0.1, 0.2, 0.3, 0.4], ddof=1) / 2)
    assert out["delta_p_mean"] == pytest.approx(0, abs=1e-12) and out["delta_p_rms"] == pytest.approx(np.sqrt((dp**2).mean()))


def test_floor_needs_every_position(spark):
    assert aggregate.scalars(facts(spark, [1, 1], floor=[0.001, 0.003])).first()["floor_mean"] == pytest.approx(0.002)
    assert aggregate.scalars(facts(spark, [1, 1], floor=[0.001, None])).first()["floor_mean"] is None


def test_nothing_finite(spark):
    out = aggregate.summarize(facts(spark, [float("nan"), float("inf")]), ()).first()
    assert out["tokens_scored"] == 0 and out["tokens_dropped_nonfinite"] == 2 and out["mean"] is None and out["se"] is None
    empty = aggregate.scalars(facts(spark, [1.0]).limit(0)).first()
    assert empty["tokens_scored"] == 0 and empty["p99"] is None


def test_histogram(spark):
    got = {r["bin"]: r["n"] for r in aggregate.histogram(facts(spark, [0, 1e-8, 0.5, 9.9, 10.5, 42, 1e6])).collect()}
    assert len(got) == 30 and sum(got.values()) == 7 and got[29] == 3 and got[0] == 2


def test_clustered_error(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(40), 25)
    x = rng.normal(size=40)[g] + rng.normal(size=1000)
    got = aggregate.clustered_se(facts(spark, x, g.tolist()), "kld", "seq_id").first()["se"]
    sums = np.bincount(g, x - x.mean())
    assert got == pytest.approx(np.sqrt(40 / 39 * (sums**2).sum()) / 1000)
    assert aggregate.clustered_se(facts(spark, [1.0, 2.0], [0, 0]), "kld", "seq_id").first()["se"] is None
    assert aggregate.clustered_se(facts(spark, [1.0, 1.0], [0, 1]), "kld", "seq_id").first()["se"] == 0


def test_sweep_error_falls_with_k(spark):
    rows = sweep.floor_sweep(circular(spark), [4, 8, 16, 0, 64, 8], V).orderBy("k").collect()
    assert [r["k"] for r in rows] == [4, 8, 16] and all(r["n"] == 40 for r in rows)
    assert sum(r["is_lowest"] for r in rows) == 1


def test_affine_checkpoint(spark):
    t = spark.createDataFrame([("m", "l.weight", "U32", [8, 8]), ("m", "l.scales", "F16", [8, 1]), ("m", "l.biases", "F16", [8, 1])], "model string, name string, dtype string, shape array<bigint>")
    mods = measure.modules(measure.with_bytes(t)).withColumn("own_group", F.lit(None).cast("int")).withColumn("default_group", F.lit(64)).withColumn("default_bits", F.lit(4))
    out = measure.totals(measure.affine_parameters(mods)).first()
    assert (out["n_params"], out["size_bytes"], out["effective_bpw"], out["format"]) == (512, 288, 4.5, "mlx-affine")


def test_gguf_scored_split(spark):
    t = spark.createDataFrame([("g", "blk.0.a", 800, [1000]), ("g", "blk.64.a", 32, [24]), ("g", "blk.64.nextn.b", 8, [1])], "model string, name string, nbytes long, shape array<bigint>")
    out = measure.gguf_totals(t, spark.createDataFrame([("g", 1024)], "model string, n_params long")).first()
    assert out["scored_bytes"] == 800 and out["scored_n_params"] == 999


def test_eviction(spark):
    rows = [("a", 3000, "2025-01-01"), ("b", 2000, "2025-01-06"), ("c", 1000, "2025-01-10")]
    e = spark.createDataFrame(rows, "key string, size_bytes long, last_used string").withColumn("locked", F.lit(False))
    gone = lambda *a: [r[0] for r in cache_admin.plan_eviction(e, *a).where("evict").collect()]
    assert gone(4000) == ["a"]
    assert "a" not in gone(1, ("a",))
    assert gone(6000) == []


@pytest.mark.parametrize("value,digits,want", [(1e-5, 4, "1.0e-05"), (-3e-6, 5, "-3.0e-06"), (3e-5, 5, "0.00003"), (None, 4, "n/a"), (0.0, 4, "0.0000")])
def test_fixed(spark, value, digits, want):
    assert spark.createDataFrame([(value,)], "v double").select(text.fixed("v", digits)).first()[0] == want


def test_chunks(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["abcde", "", "   ", "fgh", "ijklmnop"])], "id long, text string")
    kept = corpus.corpus_texts(rows, "id")
    assert kept.count() == 3
    counted = kept.withColumn("tokens", corpus.code_points("text")).withColumn("n", F.size("tokens"))
    pieces = corpus.chunks(corpus.with_offsets(counted, "n"), 4).orderBy("chunk").collect()
    assert ["".join(map(chr, r["tokens"])) for r in pieces] == ["abcd", "efgh", "ijkl", "mnop"]
    sample = corpus.calibration_chunks(kept, corpus.code_points, 2, 4, 7)
    assert [r[0] for r in sample.orderBy("seq_id").collect()] == [0, 1]
    order = corpus.sample_order(4, 2, 7)
    assert [r["tokens"] for r in sample.orderBy("seq_id").collect()] == [pieces[i]["tokens"] for i in order]
    assert corpus.stream_hash(sample) != corpus.stream_hash(sample.withColumn("seq_id", -F.col("seq_id")))
    with pytest.raises(corpus.CorpusError, match="num_samples"):
        corpus.calibration_chunks(kept, corpus.code_points, 50, 4, 7)
    with pytest.raises(corpus.CorpusError, match="template"):
        corpus.corpus_texts(spark.sql("SELECT 1 AS id, array(named_struct('role', 'user', 'content', 'x')) AS messages"), "id")
    with pytest.raises(corpus.CorpusError, match="columns"):
        corpus.corpus_texts(spark.range(1), "id")


def test_atomic_write(tmp_path, monkeypatch):
    path = tmp_path / "a" / "b.json"
    files.write_json(path, {"x": 1})
    assert path.read_text() == '{\n  "x": 1\n}\n'
    monkeypatch.setattr(files.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        files.write_text(path, "new")
    assert path.read_text().startswith("{") and len(list(path.parent.iterdir())) == 1


def test_headers(spark, tmp_path):
    head = json.dumps({"__metadata__": {"a": "b"}, "w": {"dtype": "F16", "shape": [2, 3], "data_offsets": [0, 12]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 12)
    found = files.safetensors_headers(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()
    assert [(r["name"], r["dtype"], r["shape"], r["nbytes"]) for r in found] == [("w", "F16", [2, 3], 12)]
    name = lambda s: struct.pack("<Q", len(s)) + s
    raw = b"GGUF" + struct.pack("<IQQ", 3, 1, 2) + name(b"n") + struct.pack("<II", 4, 7) + name(b"l") + struct.pack("<IIQ", 9, 8, 1) + name(b"x") + name(b"t") + struct.pack("<IQQIQ", 2, 4, 5, 1, 0)
    assert files.gguf_header(raw) == ({"n": 7, "l": ["x"]}, [("t", [4, 5], 1, 0)])


def test_sidecars(spark, tmp_path):
    assert files.provenance(spark, str(tmp_path), ["a.json", "b.json"]) is None
    (tmp_path / "b.json").write_text(json.dumps({"s": "x" * 5000, "n": None, "nested": {}, **{f"k{i}": i for i in range(200)}}))
    got = files.provenance(spark, str(tmp_path), ["a.json", "b.json"])
    assert len(got) == 64 and len(got["s"]) == 200 and "nested" not in got
    (tmp_path / "a.json").write_text("{broken")
    assert files.provenance(spark, str(tmp_path), ["a.json", "b.json"]) is None


def test_protocol():
    p = api.Protocol("c")
    assert p.score_window == (256, 512)
    assert api.Protocol("c", long_context=True).score_window == (0, 2048)
    assert p.clamped(100).top_k == 99
    for bad in ({"top_k": 0}, {"score_window": (5, 5)}, {"score_window": (0, 513)}):
        with pytest.raises(ValueError):
            api.Protocol("c", **bad)


def test_lifecycle(spark, tmp_path):
    p = api.Protocol("c", 5, 8, 1, K)
    key, manifest, status = api.ensure_teacher_cache(circular(spark), p, str(tmp_path), "t", "h1")
    assert status == "MISS" and manifest["score_window"] == [4, 8] and "score_window" not in api.manifest(tmp_path, key)
    assert api.ensure_teacher_cache(circular(spark), p, str(tmp_path), "t", "h1")[2] == "HIT"
    assert api.ensure_teacher_cache(circular(spark), p, str(tmp_path), "t", "h1", rebuild=True)[2] == "REBUILD"
    with pytest.raises(api.CacheMismatch):
        api.ensure_teacher_cache(circular(spark), p, str(tmp_path), "t", "h2")
    other = api.Protocol("c", 5, 8, 1, K, (2, 6))
    assert other.key(spark, "t") == p.key(spark, "t") != api.Protocol("c", 5, 8, 2, K).key(spark, "t")
    students = circular(spark, 1).select(F.lit("drifted").alias("student"), "seq_id", "pos", "logits").unionByName(circular(spark).select(F.lit("same").alias("student"), "seq_id", "pos", "logits"))
    out = {r["student"]: r for r in api.score_students(spark, str(tmp_path), key, students, p).collect()}
    assert out["same"]["top1"] == 1.0 and out["drifted"]["top1"] == 0.0 and out["same"]["se_method"] == "clustered-by-sequence"
    bad = circular(spark).withColumn("logits", F.raise_error(F.lit("lost")).cast("array<double>"))
    with pytest.raises(Exception):
        api.ensure_teacher_cache(bad.withColumn("logits", F.when(F.col("pos") < 100, F.col("logits"))), api.Protocol("d", 5, 8, 1, K), str(tmp_path), "t")
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == [key]


def record(**change):
    from driftquarry.plans.table_queries import _record

    return _record(**change)


def test_compare_and_plot(spark, tmp_path, capsys):
    for i, (name, mean, size) in enumerate([("acme__S-4bit", 0.02, 10), ("beta__S-8bit", 0.005, 20), ("acme__S-3bit", None, 8)]):
        r = record(student__path=f"/m/{name}", student__size_bytes=size * 10**9, kld__mean=mean, kld__floor_mean=0.004, calibration__score_window=[4, 8], teacher__path="org/S")
        files.write_json(tmp_path / f"{i}.json", r)
    files.write_text(tmp_path / "stray.json", "[1, 2]")
    pattern = str(tmp_path / "*.json")
    assert cli.main(["compare", pattern, "--out", str(tmp_path / "out.md")], spark) == 0
    table = (tmp_path / "out.md").read_text()
    assert table.index("beta") < table.index("S-4bit") < table.index("S-3bit") and f"0.0050 +/- 0.1000 {render.MARK}" in table
    assert "stray.json" in capsys.readouterr().err
    assert cli.main(["plot", pattern], spark) == 0
    import xml.etree.ElementTree as ET

    drawn = capsys.readouterr().out
    ET.fromstring(drawn)
    assert "q8" in drawn and 'class="floor"' in drawn and drawn.count("<circle") == 2
    assert cli.main(["compare", pattern, "--teacher", "nobody"], spark) == 1
    assert cli.main([], spark) == 2


def test_cache_commands(spark, tmp_path, capsys):
    for key, used in (("a", "2020-01-01T00:00:00"), ("b", "2999-01-01T00:00:00")):
        files.write_json(tmp_path / key / "manifest.json", {"last_used": used, "teacher_path": f"org/{key}"})
    assert cli.main(["cache", "list", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.split()[0] == "b"
    assert cli.main(["cache", "clear", str(tmp_path)], spark) == 1
    assert cli.main(["cache", "gc", str(tmp_path), "--older-than", "30"], spark) == 0
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()
    assert cli.main(["cache", "clear", str(tmp_path), "--teacher", "org/b"], spark) == 0
    assert not (tmp_path / "b").exists()


def test_floor_sweep_command(spark, tmp_path, capsys):
    circular(spark).write.parquet(str(tmp_path / "l"))
    assert cli.main(["floor-sweep", str(tmp_path / "l"), "--k", "4,8,64", "--window", "4:8"], spark) == 0
    assert capsys.readouterr().out.count("<- lowest") == 1


def test_score_command(spark, tmp_path, capsys):
    circular(spark).write.parquet(str(tmp_path / "t"))
    circular(spark, 1).write.parquet(str(tmp_path / "s"))
    args = ["score", str(tmp_path / "t"), str(tmp_path / "s"), "org/T", "/m/acme__T-4bit", "c", str(tmp_path / "cache"), str(tmp_path / "runs"), "--num-samples", "5", "--max-seq-len", "8", "--top-k", str(K)]
    assert cli.main(args, spark) == 0 and "MISS" in capsys.readouterr().out
    assert cli.main(args, spark) == 0 and "HIT" in capsys.readouterr().out
    found = list((tmp_path / "runs").rglob("*.json"))
    assert len(found) == 1 and found[0].parent.name == "org__t" and found[0].name.startswith("acme__T-4bit.")
    made = json.loads(found[0].read_text())
    assert made["tokens_scored"] == 20 and made["agreement"]["top1"] == 0.0 and sum(made["kld_histogram"]["counts"]) == 20
    assert cli.main(["compare", str(found[0])], spark) == 0 and "org/T" in capsys.readouterr().out


def test_record_of_nothing(spark):
    student = {"path": "s", "format": "gguf", "size_bytes": 1, "effective_bpw": 1.0, "n_params": 1, "quantization": {"kind": "gguf"}}
    tokenizer = dict.fromkeys(("mode", "identical", "encoding_parity", "forced", "diffs"))
    made = api.build_record(facts(spark, [float("nan")] * 2), api.Protocol("c", 1, 8), {"path": "t"}, student, tokenizer, 1.0)
    assert made["tokens_scored"] == 0 and made["by_position"] == [] and made["kld_histogram"] is None and made["plausibility"]["implausible"]
    with pytest.raises(api.RecordSchema, match="format"):
        api.build_record(facts(spark, [0.1]), api.Protocol("c", 1, 8), {"path": "t"}, student | {"format": "zip"}, tokenizer, 1.0)


def test_identity_and_room(tmp_path):
    assert api.identity("org/none") == "org/none" and api.identity(str(tmp_path / ".")) == str(tmp_path.resolve())
    assert api.room_for(10**9, api.Protocol("c", 1, 8, top_k=8)) == 10**9 - 8 * 57 and api.room_for(1, api.Protocol("c")) == 1


def test_self_test(spark, capsys):
    assert cli.main(["self-test"], spark) == 0 and capsys.readouterr().out.count("ok") == 3
