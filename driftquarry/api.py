"""The library's entry points: protocol, errors, teacher cache, scoring, lifecycle.

Caches and records are folders of a file system that is mounted on the driver and all executors: manifests, locks and
deletions go through the driver, shards are read and written by executors.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import shutil
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftquarry.errors import CacheMismatch, DriftError, RecordSchema, TokenizerMismatch
from driftquarry.functions import arrow_kernel, text
from driftquarry.operators import aggregate, cache_admin, score, tokenizers
from driftquarry.sources import corpus, files, shared

#: Bytes of an Arrow batch of texts: a worker holds one, and its ids.
TEXT_BYTES = 4 << 20


@dataclass(frozen=True)
class Protocol:
    """What a measurement depends on. The window defaults to the second half of a sequence, or to all of it with long context."""

    corpus: str
    num_samples: int = 512
    max_seq_len: int = 512
    seed: int = 123
    top_k: int = 32768
    score_window: tuple[int, int] | None = None
    long_context: bool = False

    def __post_init__(self):
        for name in ("num_samples", "max_seq_len", "top_k"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        length = 2048 if self.long_context else self.max_seq_len
        object.__setattr__(self, "max_seq_len", length)
        window = self.score_window or ((0, length) if self.long_context else (length // 2, length))
        if not 0 <= window[0] < window[1] <= length:
            raise ValueError("score_window must satisfy 0 <= start < end <= max_seq_len")
        object.__setattr__(self, "score_window", tuple(window))

    @staticmethod
    def window(spec: str) -> tuple[int, int]:
        start, _, end = spec.partition(":")
        return int(start), int(end)

    def clamped(self, vocab: int) -> Protocol:
        return replace(self, top_k=min(self.top_k, vocab - 1))

    def entry_bytes(self) -> int:
        """About what an entry takes: two bytes a log-probability, four an id, nine a position."""
        return self.num_samples * self.max_seq_len * (6 * self.top_k + 9)

    def key(self, spark: SparkSession, identity: str) -> str:
        row = spark.createDataFrame([(identity, self.corpus, self.num_samples, self.max_seq_len, self.seed, self.top_k)], "i string, c string, n int, l int, s long, k int")
        return row.select(text.cache_key("i", "c", "n", "l", "s", "k")).first()[0]


@contextlib.contextmanager
def entry_lock(root: str | Path, key: str, exclusive: bool, blocking: bool = True) -> Iterator[bool]:
    """Hold an entry on the driver: shared to read, exclusive to build or evict. Yields whether it is held. The lock's file is beside the entry and stays."""
    path = Path(root) / ".locks" / f"{key}.lock"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        try:
            fcntl.flock(f, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | (0 if blocking else fcntl.LOCK_NB))
        except BlockingIOError:
            yield False
            return
        yield True


def manifest(root: str | Path, key: str) -> dict | None:
    """An entry's manifest, or None if it is missing or broken."""
    try:
        found = json.loads((Path(root) / key / "manifest.json").read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(key, size_bytes, last_used, teacher_path, top_k, locked) of a cache's entries: the folders with a readable manifest."""
    rows = []
    for path in sorted(Path(root).glob("*/manifest.json")):
        found = manifest(root, path.parent.name)
        if found is not None:
            with entry_lock(root, path.parent.name, exclusive=True, blocking=False) as held:
                size = sum(p.stat().st_size for p in path.parent.rglob("*") if p.is_file())
                rows.append((path.parent.name, size, found.get("last_used"), found.get("created_at"), datetime.fromtimestamp(path.stat().st_mtime, UTC).strftime("%Y-%m-%d %H:%M:%S"), found.get("teacher_path"), found.get("top_k"), not held))
    schema = "key string, size_bytes long, last_used string, created_at string, modified string, teacher_path string, top_k int, locked boolean"
    return spark.createDataFrame(rows, schema).withColumn("last_used", cache_admin.used_at("last_used", "created_at", "modified")).drop("created_at", "modified")


def drop_entries(root: str, keys: list[str]) -> list[str]:
    """Delete entries that nobody holds; the keys of those deleted."""
    gone = []
    for key in keys:
        with entry_lock(root, key, exclusive=True, blocking=False) as held:
            if held and (Path(root) / key).exists():
                shutil.rmtree(Path(root) / key)
                gone.append(key)
    return gone


def make_room(spark: SparkSession, root: str, key: str, protocol: Protocol, budget: int | None, say: Callable[[str], None] = warnings.warn) -> list[str]:
    """Before a build: evict the least recently used entries so that the new one fits the budget, and warn where it can't fit or the disk is too full. Nothing is refused."""
    need = protocol.entry_bytes()
    gone = []
    if budget:
        if need > budget:
            say(f"one entry of about {need:,} bytes is more than the cache's budget of {budget:,}: all others go, and it is still over")
        plan = cache_admin.plan_eviction(entries(spark, root), room_for(budget, protocol), (key,))
        gone = drop_entries(root, [r[0] for r in plan.where("evict").orderBy("last_used", "key").select("key").collect()])
    Path(root).mkdir(parents=True, exist_ok=True)
    free = shutil.disk_usage(root).free
    if free < need:
        say(f"{root} has {free:,} bytes free, and the entry needs about {need:,}")
    return gone


def _problem(found: dict | None, root: str, key: str) -> str | None:
    """Why an entry can't be used, or null."""
    if found is None or found.get("format_version") != 1:
        return "no manifest of this version"
    if not found.get("num_batches") or not (Path(root) / key / "shards" / "_SUCCESS").exists():
        return "no shards"
    lost = sorted(set(found.get("shards") or range(found["num_batches"])) - set(files.entry_parts(root, key)))
    return f"shard {lost[0]} is missing" if lost else None


def stream_of(logits: DataFrame) -> str:
    """The hash of the scored tokens, in order of sequence and position; sequences may differ in length."""
    tokens = logits.where("token_id IS NOT NULL").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("t"))
    return corpus.stream_hash(tokens.select("seq_id", F.col("t.token_id").alias("tokens")))


def ensure_teacher_cache(logits: DataFrame, protocol: Protocol, root: str, identity: str, tokenizer_hash: str | None = None, rebuild: bool = False, budget: int | None = None, say: Callable[[str], None] = warnings.warn) -> tuple[str, dict, str]:
    """(key, manifest, status): the teacher's stored heads for a protocol, built if there is no valid entry.

    A second builder waits and then finds the first one's entry. A build makes room first (`budget`, in bytes) and
    leaves nothing behind if it fails. The window is put on the returned manifest only: entries keep all positions.
    """
    spark = logits.sparkSession
    vocab = logits.select(F.size("logits")).first()[0]
    used = protocol.clamped(vocab)
    key = used.key(spark, identity)

    def valid() -> dict | None:
        found = manifest(root, key)
        if _problem(found, root, key):
            return None
        if found.get("tokenizer_hash") and tokenizer_hash and found["tokenizer_hash"] != tokenizer_hash:
            raise CacheMismatch(f"entry {key} was built with another tokenizer; rebuild it")
        return found

    with entry_lock(root, key, exclusive=False):
        found = None if rebuild else valid()
    status = "HIT"
    if found is None:
        with entry_lock(root, key, exclusive=True):
            found = None if rebuild else valid()
            if found is None:
                status = "REBUILD" if rebuild and manifest(root, key) else "MISS"
                shutil.rmtree(Path(root) / key, ignore_errors=True)  # what can't be used makes room first
                make_room(spark, root, key, used, budget, say)
                now = datetime.now(UTC).isoformat()
                found = {"format_version": 1, "teacher_path": identity, "dataset": used.corpus, "num_samples": used.num_samples, "max_seq_len": used.max_seq_len, "seed": used.seed, "top_k": used.top_k, "vocab_size": vocab, "tokenizer_hash": tokenizer_hash, "created_at": now, "last_used": now}
                try:
                    found["corpus_tokens_hash"] = stream_of(logits) if "token_id" in logits.columns else None
                    found = files.write_entry(arrow_kernel.teacher_topk(logits, used.top_k), root, key, found)
                except BaseException:
                    shutil.rmtree(Path(root) / key, ignore_errors=True)
                    raise
    with entry_lock(root, key, exclusive=True):
        now = manifest(root, key)
        if now is None:
            raise CacheMismatch(f"entry {key} was removed meanwhile")
        found = now | {"last_used": datetime.now(UTC).isoformat()}
        files.write_json(Path(root) / key / "manifest.json", found)
    return key, found | {"score_window": list(used.score_window)}, status


def scored_facts(spark: SparkSession, root: str, key: str, students: DataFrame, protocol: Protocol) -> DataFrame:
    """The fact table of students against an entry, computed once while the entry is held, so that nobody evicts it under the scan."""
    with entry_lock(root, key, exclusive=False):
        return shared.checkpointed(score.score_student(files.read_entry(spark, root, key), students, protocol.score_window))


def score_students(spark: SparkSession, root: str, key: str, students: DataFrame, protocol: Protocol, by: tuple[str, ...] = ("student",)) -> DataFrame:
    """Statistics of any number of students (columns that name them, seq_id, pos, logits) against an entry."""
    return aggregate.summarize(scored_facts(spark, root, key, students, protocol), by)


def checked_tokenizers(teacher: tokenizers.Tokenizer | None, student: tokenizers.Tokenizer | None, mode: str, allow: bool = False) -> dict:
    """The `tokenizer` object of a record; tokenizers that encode text differently are an error unless allowed."""
    found = tokenizers.compared(teacher, student, mode, allow)
    if found["encoding_parity"] is False and not allow:
        raise TokenizerMismatch("; ".join(found["diffs"]))
    return found


def model_logits(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray], batch: int = 1) -> DataFrame:
    """(seq_id, pos, token_id, attn, logits) from a user's model, a function from ids (sequences by positions) to logits (sequences, positions, vocabulary) or an object that holds them as `logits`. `chunks`: (seq_id, tokens). It runs in Arrow batches, `batch` sequences of equal length at a time."""

    def run(batches):
        for rows in batches:
            ids, tokens = rows.column("seq_id").to_pylist(), rows.column("tokens").to_pylist()
            at = 0
            while at < len(ids):
                stop = at + 1
                while stop < min(at + batch, len(ids)) and len(tokens[stop]) == len(tokens[at]):
                    stop += 1
                out = model(np.array(tokens[at:stop]))
                out = np.asarray(getattr(out, "logits", out), dtype=np.float64)
                for i, own in enumerate(out):
                    n = len(own)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1]), pa.array(own.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at + i]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int64)), pa.array(tokens[at + i], pa.int32()), pa.array([True] * n), flat], names=["seq_id", "pos", "token_id", "attn", "logits"])
                at = stop

    arrow_kernel.bound_batches(chunks.sparkSession)
    return chunks.select(F.col("seq_id").cast("long").alias("seq_id"), "tokens").mapInArrow(run, "seq_id long, pos long, token_id int, attn boolean, logits array<double>")


def tokenize_with(encode: Callable[[str], list[int]]) -> Callable[[str], Column]:
    """A user's encoder as a column function for `corpus`, in Arrow batches of `TEXT_BYTES`."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        # Ids are packed text by text: as Python's lists, those of a batch would take many times its bytes.
        found = (t.as_py() for t in texts)
        packed = [None if t is None else pa.array(e if isinstance(e := encode(t), np.ndarray) else list(e), pa.int32()) for t in found]
        ends = np.cumsum([0, *[0 if p is None else len(p) for p in packed]])
        flat = pa.concat_arrays([pa.array([], pa.int32()), *[p for p in packed if p is not None]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([p is None for p in packed], pa.bool_()))

    def column(texts: Column | str) -> Column:
        if spark := SparkSession.getActiveSession():
            arrow_kernel.bound_batches(spark, TEXT_BYTES)
        return ids(texts)

    return column


def identity(teacher: str) -> str:
    """What names a teacher in keys: the resolved path if it exists here, else the id as given."""
    path = Path(teacher).expanduser()
    return str(path.resolve()) if path.exists() else teacher


def room_for(budget: int, protocol: Protocol) -> int:
    """The budget that older entries get, so that a new one fits: at least one byte, as a new entry is built even where nothing else may stay."""
    return max(budget - protocol.entry_bytes(), 1)


def record_path(spark: SparkSession, root: str, teacher: str, student: str, protocol: Protocol, mode: str | None = None) -> Path:
    """<root>/<teacher>/<student>.<digest>.json: runs of other protocols get other files."""
    row = spark.createDataFrame([(teacher, student, protocol.corpus, protocol.num_samples, protocol.max_seq_len, protocol.seed, protocol.top_k, list(protocol.score_window), mode, identity(teacher))], "t string, s string, c string, n int, l int, seed long, k int, w array<int>, m string, i string")
    folder, name, digest = row.select(text.teacher_slug("t"), text.student_slug("s"), text.run_digest("c", "n", "l", "seed", "k", "w", "m", "i")).first()
    return Path(root) / folder / f"{name}.{digest}.json"


def build_record(facts: DataFrame, protocol: Protocol, teacher: dict, student: dict, tokenizer: dict, elapsed: float, now: datetime | None = None, tokens_hash: str | None = None, provenance: dict | None = None) -> dict:
    """One student's record from its fact table, checked against the locked schema before anybody writes it."""
    from driftquarry.operators import records

    stats = aggregate.summarize(facts, ()).first().asDict()
    buckets = aggregate.by_position(facts, aggregate.Buckets(*protocol.score_window)).orderBy("bucket").collect()
    bins = aggregate.histogram(facts).orderBy("bin").collect()
    scored = stats["tokens_scored"] > 0
    reason = facts.sparkSession.createDataFrame([(stats["top1"], stats["mean"], stats["tokens_scored"])], "top1 double, mean double, tokens_scored long").select(aggregate.implausible()).first()[0]
    out = {
        "schema_version": records.SCHEMA_VERSION, "teacher": teacher, "student": student, "tokenizer": tokenizer,
        "calibration": {"corpus": protocol.corpus, "num_samples": protocol.num_samples, "max_seq_len": protocol.max_seq_len, "seed": protocol.seed, "top_k": protocol.top_k, "score_window": list(protocol.score_window), "long_context": protocol.long_context, "corpus_tokens_hash": tokens_hash},
        "kld": {k: stats[k] for k in ("mean", "se", "se_method", "floor_mean", "p50", "p95", "p99", "p999", "max")},
        "delta_p": {"mean": stats["delta_p_mean"], "se": stats["delta_p_se"], "rms": stats["delta_p_rms"]},
        "agreement": {"top1": stats["top1"], "top5": stats["top5"]},
        "tokens_scored": stats["tokens_scored"], "tokens_dropped_nonfinite": stats["tokens_dropped_nonfinite"], "elapsed_seconds": elapsed, "scorer_version": "1", "timestamp": (now or datetime.now(UTC)).isoformat(timespec="seconds"),
        "by_position": [{"range": b["range"], "tokens": b["tokens"]} | ({"mean_kld": b["mean_kld"], "p95_kld": b["p95_kld"], "top1_agreement": b["top1_agreement"]} if b["tokens"] else {}) for b in buckets] if scored else [],
        "kld_histogram": {"bin_edges": aggregate.EDGES, "counts": [b["n"] for b in bins]} if scored else None,
        "plausibility": {"implausible": reason is not None, "reason": reason},
    }
    if provenance:
        out["provenance"] = provenance
    problem = facts.sparkSession.createDataFrame([(json.dumps(out),)], "value string").select(records.reject_reason()).first()[0]
    if problem:
        raise RecordSchema(problem)
    return out
