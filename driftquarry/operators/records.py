"""JSON records of runs: validation, deduplication, grouping by protocol, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import aggregate

SCHEMA_VERSION = 1
FORMATS = ("mlx-affine", "mlx-kquant", "gguf", "mlx")
#: Keys that a record must have, and the JSON kinds of their values.
TOP = {
    "schema_version": "int", "teacher": "object", "student": "object", "tokenizer": "object", "calibration": "object", "kld": "object",
    "delta_p": "object", "agreement": "object", "tokens_scored": "int", "elapsed_seconds": "number", "scorer_version": "string", "timestamp": "string",
}
#: Keys within objects, in the order they are checked; a null value counts as present.
WITHIN = {
    "tokenizer": "mode identical encoding_parity forced diffs".split(),
    "kld": "mean se floor_mean p50 p95 p99 p999 max".split(),
    "delta_p": "mean se rms".split(),
    "agreement": "top1 top5".split(),
    "calibration": "corpus num_samples max_seq_len seed".split(),
}
STUDENT = "path format size_bytes effective_bpw n_params quantization".split()

SHAPE = """schema_version int, teacher struct<path:string,revision:string,precision:string,tokenizer_hash:string>,
student struct<path:string,format:string,size_bytes:bigint,effective_bpw:double,n_params:bigint,quantization:struct<kind:string,bits:int,group_size:int,codecs:map<string,bigint>>,scored_bpw:double>,
tokenizer struct<mode:string,identical:boolean,encoding_parity:boolean,forced:boolean>,
calibration struct<corpus:string,num_samples:int,max_seq_len:int,seed:bigint,top_k:int,score_window:string,corpus_tokens_hash:string>,
kld struct<mean:double,se:double,se_method:string,floor_mean:double,p50:double,p95:double,p99:double,p999:double,max:double>,
delta_p struct<mean:double,se:double,rms:double>, agreement struct<top1:double,top5:double>, tokens_scored bigint, elapsed_seconds double, scorer_version string, timestamp string"""


def _kind(v: Column, kind: str) -> Column:
    """Whether a JSON value, as kept by a map of strings, has a kind. Strings lose their quotes there, so numbers are told by their form."""
    tests = {"object": v.rlike(r"^\s*\{"), "int": v.rlike(r"^\s*(?:-?[0-9]+|true|false)\s*$"), "number": v.rlike(r"^\s*(?:-?[0-9.eE+-]+|-?Infinity|NaN|true|false)\s*$"), "string": v.isNotNull()}
    return F.coalesce(tests[kind], F.lit(False))


def reject_reason(value: str = "value") -> Column:
    """The first check that a record's text fails, or null."""
    is_object = F.col(value).rlike(r"^\s*\{")
    top = F.from_json(value, "map<string,string>")
    reason = F.when(~F.coalesce(is_object, F.lit(False)), "not an object").when(top.isNull() | (F.size(top) == 0), "not JSON")
    for key, kind in TOP.items():
        reason = reason.when(~F.map_contains_key(top, key), f"missing key {key}").when(~_kind(F.try_element_at(top, F.lit(key)), kind), f"{key} is not {kind}")
    reason = reason.when(F.try_element_at(top, F.lit("schema_version")).try_cast("int") != SCHEMA_VERSION, f"schema_version is not {SCHEMA_VERSION}")

    def inner(key: str) -> Column:
        return F.from_json(F.try_element_at(top, F.lit(key)), "map<string,string>")

    student = inner("student")
    for key in STUDENT:
        reason = reason.when(~F.map_contains_key(student, key), f"student.{key} missing")
    reason = reason.when(~F.coalesce(F.try_element_at(student, F.lit("format")).isin(*FORMATS), F.lit(False)), "student.format unknown")
    quant = F.from_json(F.try_element_at(student, F.lit("quantization")), "map<string,string>")
    reason = reason.when(~F.coalesce(F.map_contains_key(quant, "kind"), F.lit(False)), "student.quantization needs a kind")
    for key, names in WITHIN.items():
        for name in names:
            reason = reason.when(~F.map_contains_key(inner(key), name), f"{key}.{name} missing")
    return reason


def missing_keys(value: str = "value") -> Column:
    """Top-level keys a record lacks, sorted."""
    have = F.coalesce(F.map_keys(F.from_json(value, "map<string,string>")), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in TOP]), have))


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds the record's fields under `r`; a window that is not an array is null."""
    out = raw.withColumn("r", F.from_json(value, SHAPE))
    return out.withColumn("window", F.from_json("r.calibration.score_window", "array<int>"))


def protocol(prefix: str = "r") -> list[Column]:
    """What makes two runs comparable. With a hash of the scored tokens, the way they were made doesn't matter."""
    c = f"{prefix}.calibration"
    hashed = F.nullif(F.col(f"{c}.corpus_tokens_hash"), F.lit(""))
    return [F.col(f"{c}.{n}").alias(n) for n in ("corpus", "num_samples", "max_seq_len", "seed", "top_k")] + [F.col("window"), F.when(hashed.isNull(), F.col(f"{prefix}.tokenizer.mode")).alias("mode"), hashed.alias("tokens_hash")]


PROTOCOL = ("corpus", "num_samples", "max_seq_len", "seed", "top_k", "window", "mode", "tokens_hash")


def first_of_each(runs: DataFrame, keys: list[str], order: str = "load_order") -> DataFrame:
    """The first loaded row of each key; nulls are equal to each other."""
    return runs.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("n_ = 1").drop("n_")


def flat(parsed: DataFrame) -> DataFrame:
    """Records as flat rows with their protocol."""
    fields = {
        "teacher": "r.teacher.path", "student": "r.student.path", "format": "r.student.format", "kind": "r.student.quantization.kind", "size_bytes": "r.student.size_bytes", "bpw": "r.student.effective_bpw",
        "mean": "r.kld.mean", "se": "r.kld.se", "floor_mean": "r.kld.floor_mean", "p99": "r.kld.p99", "top1": "r.agreement.top1", "tokens_scored": "r.tokens_scored", "tokenizer_mode": "r.tokenizer.mode",
    }
    return parsed.select("load_order", "path", *[F.col(v).alias(k) for k, v in fields.items()], *protocol())


def _as_text(c: str) -> Column:
    x = F.col(c)
    if c == "window":
        return F.when(x.isNull(), "None").otherwise(F.concat(F.lit("("), F.array_join(F.transform(x, lambda v: v.cast("string")), ", "), F.lit(")")))
    return F.coalesce(x.cast("string"), F.lit("None"))


def rank_records(runs: DataFrame) -> DataFrame:
    """Adds, within each teacher, `spec` (number of the protocol, in order of its text) and `place` (by mean, without one last, then as loaded), and the flags."""
    spec = F.dense_rank().over(W.partitionBy("teacher").orderBy(*[_as_text(c) for c in PROTOCOL]))
    out = runs.withColumn("spec", spec)
    place = F.row_number().over(W.partitionBy("teacher", "spec").orderBy(F.coalesce("mean", F.lit(float("inf"))), "load_order"))
    return out.withColumn("place", place).withColumn("floor_limited", aggregate.floor_limited()).withColumn("implausible", aggregate.implausible())


def tokenizer_modes(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a")))), ", ")
