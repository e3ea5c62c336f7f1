"""Queries of readers, sinks and the cache's lifecycle, over files that each query writes and removes."""

from __future__ import annotations

import contextlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftquarry import api
from driftquarry.errors import CacheMismatch, CorpusError, DriftError, RecordSchema, TokenizerMismatch
from driftquarry.functions import text
from driftquarry.operators import render, students, tokenizers
from driftquarry.sources import checkpoints, corpus, files, shared

from .base import logits, kernel_sql, query, r8, table
from .kernel_queries import BITS, K, _students
from .table_queries import _record


@contextlib.contextmanager
def folder(spark: SparkSession) -> Iterator[Path]:
    """A folder of the shared one that the driver sees as a path too; it goes when the query has its rows."""
    where = shared.scratch(spark, "query")
    path = Path("/" + where.removeprefix("file:").lstrip("/"))
    path.mkdir(parents=True)
    try:
        yield path
    finally:
        shared.remove(spark, where)


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values(*found: tuple, names: str) -> str:
    """SQL for rows that are known."""

    def one(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in found) + f") t({names})"


def write_safetensors(path: Path, tensors: dict[str, tuple[str, list[int]]]) -> None:
    """A checkpoint file whose data is a hole: only the header is there to be read."""
    head, at = {"__metadata__": {"format": "pt"}}, 0
    for name, (dtype, shape) in tensors.items():
        size = int(np.prod(shape)) * {"F32": 4, "F16": 2, "BF16": 2, "U32": 4}[dtype]
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(head).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw)
        f.truncate(8 + len(raw) + at)


def write_gguf(path: Path, arch: str, tensors: list[tuple[str, list[int], int]]) -> None:
    text_ = lambda s: struct.pack("<Q", len(s)) + s.encode()
    raw = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 2) + text_("general.architecture") + struct.pack("<I", 8) + text_(arch) + text_("tokens") + struct.pack("<IIQ", 9, 8, 200_000) + text_("token") * 200_000
    for name, shape, kind in tensors:
        raw += text_(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, kind, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw + b"\0" * 64)


AFFINE = {"model.layers.0.q_proj.weight": ("U32", [8, 8]), "model.layers.0.q_proj.scales": ("F16", [8, 1]), "model.layers.0.q_proj.biases": ("F16", [8, 1]), "model.norm.weight": ("F32", [8])}


def _affine(root: Path) -> str:
    first = {k: v for k, v in AFFINE.items() if "norm" not in k}
    write_safetensors(root / "a" / "model-1.safetensors", first)
    write_safetensors(root / "a" / "model-2.safetensors", {"model.norm.weight": AFFINE["model.norm.weight"]})
    files.write_json(root / "a" / "model.safetensors.index.json", {"weight_map": {k: f"model-{1 if k in first else 2}.safetensors" for k in AFFINE}})
    files.write_json(root / "a" / "config.json", {"quantization": {"bits": 4, "group_size": 64}, "vocab_size": 64})
    return str(root / "a")


def _gguf(root: Path) -> str:
    write_gguf(root / "g-00001-of-00002.gguf", "toy", [("blk.0.attn_q.weight", [256, 4], 12), ("token_embd.weight", [256, 2], 0)])
    write_gguf(root / "g-00002-of-00002.gguf", "toy", [("blk.1.nextn.weight", [256, 1], 14), ("blk.1.attn_q.weight", [256, 1], 12)])
    return str(root / "g-00001-of-00002.gguf")


@query("sc3_columns", "SELECT 'both' AS corpus, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') UNION ALL SELECT 'chat', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'neither: text or messages', 0")
def sc3(spark, d):
    """`text` is taken before `messages`; without either the columns are named."""
    docs = table(spark, d, "documents").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    found = [corpus.corpus_texts(docs, "doc_id").select(F.lit("both").alias("corpus")), corpus.corpus_texts(chats, "conv_id", lambda role, content: F.concat(role, F.lit(": "), content)).select(F.lit("chat").alias("corpus"))]
    out = found[0].unionByName(found[1]).groupBy("corpus").agg(F.count("*").alias("n"))
    try:
        corpus.corpus_texts(docs.select("doc_id", "lang"), "doc_id")
    except CorpusError as e:
        return out.unionByName(rows(spark, [("neither: " + str(e)[3:19], 0)], "corpus string, n long"))


@query("sc6_manifests", values(("broken", None), ("good", 32), ("list", None), names="key, top_k"))
def sc6(spark, d):
    with folder(spark) as root:
        files.write_json(root / "good" / "manifest.json", {"format_version": 1, "top_k": 32})
        files.write_text(root / "broken" / "manifest.json", "{")
        files.write_text(root / "list" / "manifest.json", "[1]")
        (root / "empty").mkdir()
        found = files.read_manifests(spark, f"file://{root}").select("key", F.get_json_object("value", "$.top_k").cast("int").alias("top_k")).collect()
        return rows(spark, [tuple(r) for r in found], "key string, top_k int")


@query("sc7_record_files", values(("/m/acme__S-4bit", 0, True), ("/m/beta__S-8bit", 1, True), ("stray.json", None, False), names="name, load_order, valid"))
def sc7(spark, d):
    """Globs in order, each file once, the rest with a reason."""
    with folder(spark) as root:
        for i, name in enumerate(("acme__S-4bit", "beta__S-8bit")):
            files.write_json(root / "runs" / "deep" / f"{i}.json", _record(student__path=f"/m/{name}"))
        files.write_text(root / "runs" / "stray.json", '"a string"')
        valid, rejected = files.load_records(spark, [f"{root}/runs/**/[01].json", f"{root}/runs/**/*.json"])
        found = [(r["student"], r["load_order"], True) for r in valid.collect()] + [(Path(r["path"]).name, None, False) for r in rejected.collect()]
        return rows(spark, found, "name string, load_order long, valid boolean")


@query("sc8_safetensors", values(*[(k, v[0], str(v[1]), int(np.prod(v[1])) * (2 if v[0] == "F16" else 4), "model-2.safetensors" if "norm" in k else "model-1.safetensors") for k, v in AFFINE.items()], names="name, dtype, shape, nbytes, shard"))
def sc8(spark, d):
    with folder(spark) as root:
        found = checkpoints.safetensors_table(spark, [_affine(root)]).collect()
        return rows(spark, [(r["name"], r["dtype"], str(r["shape"]), r["nbytes"], r["shard"]) for r in found], "name string, dtype string, shape string, nbytes long, shard string")


@query("sc9_gguf", values(("blk.0.attn_q.weight", "q4_k", 576), ("token_embd.weight", "f32", 2048), ("blk.1.nextn.weight", "q6_k", 210), ("blk.1.attn_q.weight", "q4_k", 144), names="name, codec, nbytes"))
def sc9(spark, d):
    with folder(spark) as root:
        found = checkpoints.gguf_table(spark, [_gguf(root)]).collect()
        return rows(spark, [(r["name"], r["codec"], r["nbytes"]) for r in found], "name string, codec string, nbytes long")


@query("sc10_sidecar", values(("bits", "4"), ("made", "by hand"), ("none", "None"), names="k, v"))
def sc10(spark, d):
    """The first sidecar that exists, its scalars only."""
    with folder(spark) as root:
        files.write_json(root / "recipe.json", {"made": "by hand", "bits": 4, "nested": {"a": 1}, "list": [1], "none": None})
        return rows(spark, [(k, str(v)) for k, v in students.recipe(spark, str(root)).items()], "k string, v string")


@query("pf31_scalars", values((64, 200, False), names="kept, longest, nested"))
def pf31(spark, d):
    with folder(spark) as root:
        files.write_json(root / "quant-recipe.json", {"s": "x" * 5000, "nested": {"a": 1}} | {f"k{i}": i for i in range(200)})
        found = students.recipe(spark, str(root))
        return rows(spark, [(len(found), len(found["s"]), "nested" in found)], "kept int, longest int, nested boolean")


def _cache(root: Path, *found: tuple[str, int, int]) -> None:
    """Entries (key, days since use, bytes)."""
    for key, days, size in found:
        files.write_json(root / key / "manifest.json", {"last_used": (datetime(2030, 1, 1, tzinfo=UTC) - timedelta(days=days)).isoformat(), "teacher_path": f"org/{key}", "top_k": 8})
        (root / key / "shard").write_bytes(b"\0" * size)


@query("sc11_cache_scan", values(("a", "org/a", "2029-12-22"), ("b", "org/b", "2029-12-31"), names="key, teacher_path, day"))
def sc11(spark, d):
    with folder(spark) as root:
        _cache(root, ("a", 10, 5), ("b", 1, 5))
        (root / "stray").mkdir()
        found = api.entries(spark, str(root)).select("key", "teacher_path", F.date_format("last_used", "yyyy-MM-dd").alias("day")).collect()
        return rows(spark, [tuple(r) for r in found], "key string, teacher_path string, day string")


@query("sc12_config", values(("broken", None), ("file", 64), ("folder", 64), ("missing", None), names="given, vocab_size"))
def sc12(spark, d):
    with folder(spark) as root:
        path = _affine(root)
        files.write_text(root / "b" / "config.json", "[")
        given = {"folder": path, "file": f"{path}/config.json", "broken": str(root / "b"), "missing": str(root / "none")}
        return rows(spark, [(k, checkpoints.config(v).get("vocab_size")) for k, v in given.items()], "given string, vocab_size int")


@query("p4_measured", values(("a", "mlx-affine", 520, 4.92307692, "affine"), ("g", "gguf", 2048, 11.6328125, "gguf"), ("k", "mlx-kquant", 288, 7.55555556, "kquant"), ("u", "mlx", 16, 32.0, "none"), names="student, format, n_params, bpw, kind"))
def p4(spark, d):
    """Students measured from their headers: affine, block-quantised in two parts, per tensor, unquantised."""
    with folder(spark) as root:
        write_safetensors(root / "u" / "model.safetensors", {"w.weight": ("F32", [4, 4])})
        write_safetensors(root / "k" / "model.safetensors", {"q.weight": ("U32", [36]), "p.weight": ("F32", [30]), "r.weight": ("F32", [2])})
        files.write_json(root / "k" / "config.json", {"quantization_config": {"per_tensor": {"q": "q4_k"}}})
        found = [(n, students.measured(spark, p)) for n, p in (("a", _affine(root)), ("g", _gguf(root)), ("k", str(root / "k")), ("u", str(root / "u")))]
        return rows(spark, [(n, s["format"], s["n_params"], round(s["effective_bpw"], 8), s["quantization"]["kind"]) for n, s in found], "student string, format string, n_params long, bpw double, kind string")


@query("sk1_atomic", values(("after a failure", "old"), ("after a write", "new"), ("files", "1"), names="step, content"))
def sk1(spark, d):
    with folder(spark) as root:
        path = root / "x.txt"
        files.write_text(path, "old")
        with contextlib.suppress(UnicodeEncodeError):
            files.write_text(path, "half \ud800")
        kept = path.read_text()
        files.write_text(path, "new")
        return rows(spark, [("after a failure", kept), ("after a write", path.read_text()), ("files", str(len(list(root.iterdir()))))], "step string, content string")


@query("sk2_shards", f"WITH {kernel_sql(K)} SELECT count(*) AS positions, true AS complete, true AS sized, round(avg(kld), 8) + 0.0 AS floor FROM s")
def sk2(spark, d):
    """An entry is shards, then a manifest that knows their number and size."""
    with folder(spark) as root:
        key, made, _ = api.ensure_teacher_cache(logits(spark, d), api.Protocol("c", 1, 10, top_k=K), str(root), "t", say=lambda m: None)
        n, floor = files.read_entry(spark, f"file://{root}", key).agg(F.count("*"), r8(F.avg("floor_kld"))).first()
        return rows(spark, [(n, len(files.entry_parts(root, key)) == made["num_batches"] > 0, made["size_bytes"] > 0, floor)], "positions long, complete boolean, sized boolean, floor double")


@query("sk4_record_path", values(("org__t", "acme__S-4bit", 8, True), names="folder, student, digest, other_protocol_other_file"))
def sk4(spark, d):
    first, second = (api.record_path(spark, "/r", "org/T", "/m/acme__S-4bit", api.Protocol("c", seed=s), "given") for s in (1, 2))
    name, digest, _ = first.name.rsplit(".", 2)
    return rows(spark, [(first.parent.name, name, len(digest), first != second)], "folder string, student string, digest int, other_protocol_other_file boolean")


@query("sk5_card", values(("## Divergence from model",), ("| mean KL divergence (nats) | 0.0200 +/- 0.1000 |",), ("| size | 15.0 GB |",), names="line"))
def sk5(spark, d):
    """The card's headline, without any path of the machine that made it."""
    made = _record(teacher__path="/home/somebody/Model", student__path="/home/somebody/x/acme__S-4bit", student__size_bytes=15 * 10**9, kld__mean=0.02, kld__floor_mean=0.001)
    card, full = render.card(spark, made), render.report(spark, made)
    if "/home" in card or "0.0200" not in full:
        raise DriftError("the card names a path, or the report lacks the mean")
    return rows(spark, [(line,) for line in card.split("\n") if line.startswith(("## ", "| mean KL", "| size"))], "line string")


@query("pf20_windows", values(("default", 256, 512), ("long", 0, 2048), ("own", 3, 9), ("bad window", None, None), ("bad k", None, None), names="protocol, first, last"))
def pf20(spark, d):
    """Default windows, and arguments that are refused."""
    found = []
    for name, given in (("default", {}), ("long", {"long_context": True}), ("own", {"score_window": api.Protocol.window("3:9")}), ("bad window", {"score_window": (5, 600)}), ("bad k", {"top_k": 0})):
        try:
            found.append((name, *api.Protocol("c", **given).score_window))
        except ValueError:
            found.append((name, None, None))
    return rows(spark, found, "protocol string, first int, last int")


@query("t7_seeded_order", values(*[(i, int(c)) for i, c in enumerate(np.random.default_rng(123).permutation(1000)[:64])], names="place, chunk"))
def t7(spark, d):
    return rows(spark, list(enumerate(corpus.sample_order(1000, 64, 123))), "place int, chunk int")


@query("t8_paths", values((0, 1, "b.json"), (1, 0, "a.json"), (2, 0, "c.json"), names="place, pattern, name"))
def t8(spark, d):
    """Files in order of pattern, then path; the first pattern that finds a file has it."""
    with folder(spark) as root:
        for name in "abc":
            files.write_text(root / f"{name}.json", "{}")
        found = files.expand([f"{root}/[b].json", f"{root}/*.json"])
        return rows(spark, [(i, 1 - p, Path(f).name) for i, (p, f) in enumerate(found)], "place int, pattern int, name string")


@query("f7_ticks", values(("linear", "0 2 4 6 8 10"), ("log", "0.005 0.01 0.02 0.05 0.1 0.2"), ("one", "3"), names="axis, ticks"))
def f7(spark, d):
    given = (("linear", render.linear_ticks(0, 11)), ("log", render.log_ticks(0.004, 0.3)), ("one", render.linear_ticks(3, 3)))
    return rows(spark, [(name, " ".join(f"{t:g}" for t in ticks)) for name, ticks in given], "axis string, ticks string")


@query("f16_identity", values(("an id", "org/none"), ("a folder", "resolved"), names="given, identity"))
def f16(spark, d):
    with folder(spark) as root:
        return rows(spark, [("an id", api.identity("org/none")), ("a folder", "resolved" if api.identity(f"{root}/../{root.name}") == str(root.resolve()) else "as given")], "given string, identity string")


@query("f19_now", values((True, True), names="of_record, of_manifest"))
def f19(spark, d):
    """Times are UTC and say so: in seconds on records, finer on manifests."""
    with folder(spark) as root:
        _, made, _ = api.ensure_teacher_cache(logits(spark, d), api.Protocol("c", 1, 10, top_k=4), str(root), "t", say=lambda m: None)
        of_record = datetime.now(UTC).isoformat(timespec="seconds")
        pattern = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00$"
        return rows(spark, [(of_record, made["last_used"])], "a string, b string").select(F.col("a").rlike(pattern).alias("of_record"), F.col("b").rlike(pattern).alias("of_manifest"))


@query("c2_lifecycle", values((1, "MISS"), (2, "HIT"), (3, "REBUILD"), (4, "another tokenizer"), (5, "MISS"), (6, "removed after a failure"), names="step, status"))
def c2(spark, d):
    """An entry's life: built, found, rebuilt, refused to another tokenizer, built anew when a shard is lost, gone when a build fails (C9)."""
    with folder(spark) as root:
        found, protocol = [], api.Protocol("c", 1, 10, top_k=4)
        run = lambda tok="h", p=protocol, x=logits(spark, d), **kw: api.ensure_teacher_cache(x, p, str(root), "t", tok, say=lambda m: None, **kw)
        found += [run()[2], run()[2], run(rebuild=True)[2]]
        try:
            run("other")
        except CacheMismatch:
            found.append("another tokenizer")
        key = protocol.key(spark, "t")
        next((root / key / "shards").glob("part-*.parquet")).unlink()
        found.append(run()[2])
        # Not in `logits`, of which the first row is looked at before a build begins.
        bad = logits(spark, d).withColumn("attn", F.when(F.col("vec_id") > 300, F.raise_error(F.lit("lost")).cast("boolean")).otherwise(F.col("attn")))
        try:
            run(p=api.Protocol("d", 1, 10, top_k=4), x=bad)
        except Exception:
            found.append("removed after a failure" if not (root / api.Protocol("d", 1, 10, top_k=4).key(spark, "t")).exists() else "left behind")
        return rows(spark, [(i + 1, s) for i, s in enumerate(found)], "step int, status string")


@query("c4_make_room", values(("evicted", "a"), ("kept", "b"), ("kept", "new"), names="what, key"))
def c4(spark, d):
    """Room for what comes is made before it is built: the oldest goes, the entry itself is protected."""
    with folder(spark) as root:
        _cache(root, ("a", 9, 4000), ("b", 1, 2000), ("new", 99, 10))
        p = api.Protocol("c", 1, 10, top_k=50)
        gone = api.make_room(spark, str(root), "new", p, 2600 + p.entry_bytes(), lambda m: None)
        return rows(spark, [("evicted", k) for k in gone] + [("kept", x.name) for x in root.iterdir() if not x.name.startswith(".")], "what string, key string")


@query("c5_warnings", values(("budget", True), ("disk", True), ("small", False), names="scenario, warned"))
def c5(spark, d):
    with folder(spark) as root:
        found = []
        for name, protocol, budget in (("budget", api.Protocol("c", 1, 10, top_k=50), 10), ("disk", api.Protocol("c", 10**9, 10**4, top_k=10**6), None), ("small", api.Protocol("c", 1, 10, top_k=50), 10**9)):
            said: list[str] = []
            api.make_room(spark, str(root), "k", protocol, budget, said.append)
            found.append((name, bool(said)))
        return rows(spark, found, "scenario string, warned boolean")


@query("c8_touch", values((True, True), names="used_again, else_as_built"))
def c8(spark, d):
    with folder(spark) as root:
        run = lambda: api.ensure_teacher_cache(logits(spark, d), api.Protocol("c", 1, 10, top_k=4), str(root), "t", say=lambda m: None)[1]
        first, second = run(), run()
        differ = {k for k in first if first[k] != second[k]}
        return rows(spark, [(second["last_used"] > first["last_used"], differ <= {"last_used"})], "used_again boolean, else_as_built boolean")


@query("c10_locks", values(("shared beside shared", True), ("exclusive beside shared", False), ("exclusive alone", True), ("evicted while held", False), names="scenario, got"))
def c10(spark, d):
    with folder(spark) as root:
        _cache(root, ("k", 1, 5))
        found = []
        with api.entry_lock(root, "k", exclusive=False):
            with api.entry_lock(root, "k", exclusive=False, blocking=False) as held:
                found.append(("shared beside shared", held))
            with api.entry_lock(root, "k", exclusive=True, blocking=False) as held:
                found.append(("exclusive beside shared", held))
            found.append(("evicted while held", bool(api.drop_entries(str(root), ["k"]))))
        with api.entry_lock(root, "k", exclusive=True, blocking=False) as held:
            found.append(("exclusive alone", held))
        return rows(spark, found, "scenario string, got boolean")


_API2 = f"""WITH {kernel_sql(K, BITS)} SELECT bits, count(*) AS tokens, round(avg(greatest(kld, 0)), 8) AS mean, round(quantile_cont(greatest(kld, 0), 0.95), 8) AS p95, round(avg(top1::INT), 8) AS top1
FROM s WHERE attn AND pos >= 5 GROUP BY bits"""


@query("api2_score_students", _API2)
def api2(spark, d):
    """Through the library: cache the teacher, score all students against the entry in its default window (API1, API2)."""
    with folder(spark) as root:
        protocol = api.Protocol("c", 1, 10, top_k=K)
        key, _, _ = api.ensure_teacher_cache(logits(spark, d), protocol, str(root), "t", say=lambda m: None)
        stats = api.score_students(spark, f"{root}", key, _students(spark, d).select("bits", "seq_id", "pos", "logits"), protocol, ("bits",))
        return rows(spark, [tuple(r) for r in stats.select("bits", F.col("tokens_scored").alias("tokens"), r8("mean"), r8("p95"), r8("top1")).collect()], "bits int, tokens long, mean double, p95 double, top1 double")


@query("api4_errors", values(("CacheMismatch", True), ("CorpusError", True), ("RecordSchema", True), ("TokenizerMismatch", True), names="error, is_base"))
def api4(spark, d):
    """Each error is raised by what it is for, and all have one base."""
    found = []
    a, b = (tokenizers.Tokenizer(list("abc"), lambda t, n=n: [ord(c) % n for c in t]) for n in (7, 5))
    b = tokenizers.Tokenizer(list("abd"), b.encode)
    nothing = spark.createDataFrame([], "seq_id long, pos long, kld double, top1 boolean, top5 boolean, delta_p double, floor_kld double")
    with folder(spark) as root:
        run = lambda tok: api.ensure_teacher_cache(logits(spark, d), api.Protocol("c", 1, 10, top_k=4), str(root), "t", tok, say=lambda m: None)
        run("one")
        for call in (lambda: run("two"), lambda: api.checked_tokenizers(a, b, "given"), lambda: api.build_record(nothing, api.Protocol("c"), {"path": "t"}, {}, {}, 0.0), lambda: corpus.sampled(nothing, 1, 2, 3)):
            try:
                call()
            except (CacheMismatch, TokenizerMismatch, RecordSchema, CorpusError) as e:
                found.append((type(e).__name__, isinstance(e, DriftError)))
    return rows(spark, found, "error string, is_base boolean")


@query("api5_model", "SELECT seq_id, pos, (seq_id * 3 + pos) % 7 AS token_id, ((seq_id * 3 + pos) % 7 + pos) % 11 AS best FROM range(20) s(seq_id), range(8) p(pos)")
def api5(spark, d):
    """A user's model over chunks of tokens, in Arrow batches."""

    def model(ids):
        peak = (ids + np.arange(ids.shape[1])) % 11
        return -np.abs(np.arange(11) - peak[..., None]).astype(float)

    chunks = spark.range(20).select(F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: ((F.col("id") * 3 + p) % 7).cast("int")).alias("tokens"))
    out = api.model_logits(chunks, model, 3)
    return out.select("seq_id", "pos", F.col("token_id").cast("long").alias("token_id"), (F.array_position("logits", F.array_max("logits")) - 1).alias("best"))


@query("api6_tokenizer", "SELECT doc_id, length(text)::INT AS n, (unicode(left(text, 1)) % 4096)::INT AS first FROM documents WHERE length(text) > 0")
def api6(spark, d):
    """A user's encoder as a column function."""
    encode = api.tokenize_with(lambda t: [ord(c) % 4096 for c in t])
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", encode("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"))


@query("j11_tokenizers", values(("same", True, True, 0), ("other special", False, True, 1), ("other text", False, False, 1), ("not checked", None, None, 1), names="pair, identical, encoding_parity, diffs"))
def j11_pairs(spark, d):
    """The tokenizer object of records, for pairs of tokenizers."""
    one = tokenizers.Tokenizer(list("abc"), lambda t: [ord(c) for c in t], {"bos_token_id": 1})
    pairs = (("same", tokenizers.Tokenizer(list("abc"), one.encode, {"bos_token_id": 1})), ("other special", tokenizers.Tokenizer(list("abc"), one.encode, {"bos_token_id": 2})), ("other text", tokenizers.Tokenizer(list("abx"), lambda t: [ord(c) for c in t.lower()], {"bos_token_id": 1})), ("not checked", None))
    found = [(name, tokenizers.compared(one, other, "given", True)) for name, other in pairs]
    return rows(spark, [(n, f["identical"], f["encoding_parity"], len(f["diffs"])) for n, f in found], "pair string, identical boolean, encoding_parity boolean, diffs int")


@query("f15_witness", f"WITH t AS (SELECT vec_id // 10 AS s, vec_id AS i, label AS v FROM embeddings) SELECT left(sha256(unhex(string_agg(printf('%02x%02x%02x00', v % 256, (v // 256) % 256, v // 65536), '' ORDER BY i))), 16) AS corpus_tokens_hash FROM t")
def f15_witness(spark, d):
    """The token stream of an entry, as its manifest has it and records repeat it."""
    return rows(spark, [(api.stream_of(logits(spark, d)),)], "corpus_tokens_hash string")
