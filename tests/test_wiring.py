"""Scoring from end to end: students measured from their files, tokenizers compared, records, reports and cards."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftquarry import api, cli
from driftquarry.errors import TokenizerMismatch
from driftquarry.operators import aggregate, render, students, tokenizers
from driftquarry.plans import file_queries
from driftquarry.plans.table_queries import _record
from driftquarry.sources import checkpoints, corpus, files

from .test_operators import K, circular


def test_score_measures_the_student_and_says_what_was_not_checked(spark, tmp_path, capsys):
    circular(spark).write.parquet(str(tmp_path / "t"))
    circular(spark, 1).write.parquet(str(tmp_path / "s"))
    weights = file_queries._affine(tmp_path / "m")
    files.write_json(tmp_path / "m" / "a" / "recipe.json", {"made": "by hand", "nested": {}})
    args = ["score", str(tmp_path / "t"), str(tmp_path / "s"), "/somewhere/local/T", weights, "c", str(tmp_path / "cache"), str(tmp_path / "runs"), "--num-samples", "5", "--max-seq-len", "8", "--top-k", str(K)]
    args += ["--report", str(tmp_path / "report.md"), "--card", str(tmp_path / "card.md"), "--cache-max-gb", "1e-9"]
    assert cli.main(args, spark) == 0
    assert "budget" in capsys.readouterr().err  # warned, not refused
    [path] = (tmp_path / "runs").rglob("*.json")
    made = json.loads(path.read_text())
    assert made["student"]["size_bytes"] > 320 and made["student"]["n_params"] == 520 and made["student"]["format"] == "mlx-affine"
    assert made["student"]["quantization"] == {"kind": "affine", "bits": 4, "group_size": 64, "mode": "affine"}
    assert made["tokenizer"]["identical"] is None and made["tokenizer"]["encoding_parity"] is None
    assert made["calibration"]["corpus_tokens_hash"] == api.stream_of(circular(spark)) and made["provenance"] == {"made": "by hand"}
    report, card = (tmp_path / "report.md").read_text(), (tmp_path / "card.md").read_text()
    assert "not checked" in report and "affine; bits 4" in report and "made: by hand" in report
    assert str(tmp_path) not in card and "/somewhere" not in card and "Implausible" in card
    assert cli.main(["plot", str(path)], spark) == 0 and "<circle" in capsys.readouterr().out


def test_measures_of_odd_checkpoints(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        students.measured(spark, str(tmp_path))
    first = file_queries._gguf(tmp_path)
    (tmp_path / "g-00002-of-00002.gguf").unlink()
    with pytest.raises(FileNotFoundError, match="00002"):
        checkpoints.gguf_shards(first)
    (tmp_path / "cut.gguf").write_bytes(b"GGUF" + b"\3\0\0\0" + b"\xff" * 12)
    with pytest.raises(Exception, match="within its head"):
        checkpoints.gguf_table(spark, [str(tmp_path / "cut.gguf")]).collect()
    file_queries.write_safetensors(tmp_path / "u" / "model.safetensors", {"a.weight": ("BF16", [4, 4]), "b.weight": ("F32", [2])})
    got = students.measured(spark, str(tmp_path / "u"))
    assert got["quantization"] == {"kind": "none", "dtype": "bfloat16"} and got["effective_bpw"] == pytest.approx(40 * 8 / 18)
    assert students.unmeasured("x.gguf")["size_bytes"] is None


def test_tokenizers_that_differ(spark):
    one = tokenizers.Tokenizer(list("abc"), lambda t: [ord(c) for c in t])
    other = tokenizers.Tokenizer(list("abx"), lambda t: [ord(c.lower()) for c in t])
    with pytest.raises(TokenizerMismatch):
        api.checked_tokenizers(one, other, "given")
    forced = api.checked_tokenizers(one, other, "given", allow=True)
    assert forced["forced"] and not forced["encoding_parity"]
    failing = tokenizers.Tokenizer(list("abx"), lambda t: 1 / 0)
    assert tokenizers.parity(one, failing)[0] is False
    assert tokenizers.stream_status(None, "x", "given") == (None, None) and tokenizers.stream_status("x", "x", "given") == (True, None)
    same, why = tokenizers.stream_status("x", "y", "synthesized")
    assert same is False and "rebuild" in why


def test_from_corpus_to_scores(spark, tmp_path):
    """A corpus, a user's tokenizer and a user's model: chunks, logits, cache, statistics."""
    texts = spark.createDataFrame([(i, "some words that fill a chunk or two, row %d" % i) for i in range(40)], "row_idx int, text string")
    chunks = corpus.calibration_chunks(corpus.corpus_texts(texts, "row_idx"), api.tokenize_with(lambda t: [ord(c) % 32 for c in t]), 6, 16, 1)

    def model(ids):
        return np.cos(ids[..., None] * 0.37 + np.arange(32) * 0.91) * 3

    logits = api.model_logits(chunks, model, batch=4)
    protocol = api.Protocol("texts", 6, 16, 1, 8)
    key, made, _ = api.ensure_teacher_cache(logits, protocol, str(tmp_path), "t", say=lambda m: None)
    assert made["corpus_tokens_hash"] == corpus.stream_hash(chunks)
    drifted = api.model_logits(chunks, lambda ids: model(ids) + np.arange(32) * 0.01).select(F.lit("d").alias("student"), "seq_id", "pos", "logits")
    row = api.score_students(spark, str(tmp_path), key, drifted, protocol).first()
    assert row["tokens_scored"] == 6 * 8 and row["mean"] > 0 and row["se_method"] == "clustered-by-sequence"


def test_reports_of_other_quantisations(spark):
    for quant, want in (({"kind": "kquant", "codecs": {}}, "n/a"), ({"kind": "gguf", "arch": "toy", "codecs": {"q4_k": 3}}, "3 q4_k"), ({"kind": "none", "dtype": "float16"}, "none (float16"), ({"kind": None}, "not measured")):
        assert want in render.report(spark, _record(student__quantization=quant))
    shifted = _record(delta_p__mean=1e-7, delta_p__se=1e-8, kld__floor_mean=0.05, kld__mean=0.06, agreement__top1=0.99, tokens_scored=10)
    text = render.report(spark, shifted)
    assert "e-0" in text and "ranks hold" in text  # small shifts aren't flattened to zero
    assert "ranks hold" not in render.card(spark, _record(kld__mean=2.0, kld__floor_mean=1.5, agreement__top1=0.2, tokens_scored=10))


def test_entries_under_a_scan_stay(spark, tmp_path):
    key, _, _ = api.ensure_teacher_cache(circular(spark), api.Protocol("c", 5, 8, 1, K), str(tmp_path), "t", say=lambda m: None)
    with api.entry_lock(tmp_path, key, exclusive=False):
        assert api.drop_entries(str(tmp_path), [key]) == [] and api.entries(spark, str(tmp_path)).first()["locked"]
    assert api.drop_entries(str(tmp_path), [key]) == [key]


def test_aggregates_without_quantiles(spark):
    facts = spark.createDataFrame([(0, 0, 0.5, True, True, 0.0, 0.1)], "seq_id int, pos int, kld double, top1 boolean, top5 boolean, delta_p double, floor_kld double")
    assert "p50" not in aggregate.scalars(facts, (), {}).columns and aggregate.scalars(facts).first()["p50"] == 0.5
