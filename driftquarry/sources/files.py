"""Records, manifests, checkpoint headers and sidecars from files; atomic writes of small results."""

from __future__ import annotations

import glob
import json
import os
import struct
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.operators import records


def expand(patterns: list[str]) -> list[tuple[int, str]]:
    """(pattern's number, path): files in order of pattern and path, each path once, with ~ and ** understood."""
    seen, out = set(), []
    for i, pattern in enumerate(patterns):
        for path in sorted(glob.glob(os.path.expanduser(pattern), recursive=True)):
            path = os.path.abspath(path)
            if path not in seen and os.path.isfile(path):
                seen.add(path)
                out.append((i, path))
    return out


def load_records(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): parsed records, the first loaded of each student, teacher and protocol, and (path, reason) of the rest that can't be used."""
    files = expand(patterns)
    order = spark.createDataFrame([(n, p) for n, (_, p) in enumerate(files)], "load_order long, path string")
    if not files:
        raw = order.withColumn("value", F.lit(None).cast("string"))
    else:
        texts = spark.read.text([p for _, p in files], wholetext=True).select("value", F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/").alias("path"))
        raw = order.join(texts, "path")
    judged = raw.withColumn("reason", records.reject_reason())
    flat = records.flat(records.parse(judged.where("reason IS NULL")))
    return records.first_of_each(flat, ["student", "teacher", *records.PROTOCOL]), judged.where("reason IS NOT NULL").select("path", "reason")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(key, manifest text, modified, size_bytes) of the direct children of a cache's root that hold a manifest."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").load(f"{root}/*")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("key"), F.decode("content", "utf-8").alias("value"), F.col("modificationTime").alias("modified"))


def safetensors_headers(files: DataFrame) -> DataFrame:
    """(path, name, dtype, shape, nbytes) of the tensors of safetensors files, given (path, content): only the header's bytes are parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                (n,) = struct.unpack("<Q", content[:8])
                for name, t in json.loads(content[8 : 8 + n]).items():
                    if name != "__metadata__":
                        rows.append((path, name, t["dtype"], [int(x) for x in t["shape"]], int(t["data_offsets"][1] - t["data_offsets"][0])))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "nbytes"])

    return files.mapInPandas(run, "path string, name string, dtype string, shape array<long>, nbytes long")


_GGUF_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


def gguf_header(content: bytes) -> tuple[dict, list[tuple[str, list[int], int, int]]]:
    """(metadata, tensors as (name, shape, type id, offset)) of a GGUF file's head."""
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from("<" + fmt, content, at)
        at += struct.calcsize("<" + fmt)
        return out[0]

    def string() -> str:
        nonlocal at
        n = take("Q")
        at += n
        return content[at - n : at].decode("utf-8")

    def value(kind: int):
        if kind == 8:
            return string()
        if kind == 9:
            inner, n = take("I"), take("Q")
            return [value(inner) for _ in range(n)]
        return take(_GGUF_SCALARS[kind])

    if content[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    at = 4
    take("I")
    n_tensors, n_pairs = take("Q"), take("Q")
    meta = {}
    for _ in range(n_pairs):
        key = string()
        meta[key] = value(take("I"))
    tensors = []
    for _ in range(n_tensors):
        name = string()
        shape = [take("Q") for _ in range(take("I"))]
        tensors.append((name, shape, take("I"), take("Q")))
    return meta, tensors


def provenance(spark: SparkSession, directory: str, names: list[str]) -> dict | None:
    """Scalars of the first sidecar that exists: 64 keys at most, strings cut at 200 characters; null if that file can't be read as an object."""
    path = next((p for n in names if (p := Path(directory) / n).exists()), None)
    if path is None:
        return None
    value = spark.read.text(str(path), wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).first()
    try:
        kinds = json.loads(path.read_text())
    except ValueError:
        return None
    if value is None or value[0] is None or not isinstance(kinds, dict):
        return None
    kept = [(k, v) for k, v in kinds.items() if v is None or isinstance(v, (str, bool, int, float))][:64]
    return {k: v[:200] if isinstance(v, str) else v for k, v in kept}


def write_text(path: str | Path, text: str) -> None:
    """Replace a file in one step: a temporary file beside it is written, flushed to disk and renamed; on failure it goes."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value: object) -> None:
    write_text(path, json.dumps(value, indent=2) + "\n")


def entry_parts(root: str, key: str) -> list[int]:
    """Numbers of the shards that an entry has."""
    return sorted(int(p.name.split("-")[1]) for p in (Path(root) / key / "shards").glob("part-*.parquet"))


def write_entry(teacher: DataFrame, root: str, key: str, manifest: dict) -> dict:
    """A cache entry: shards as Parquet by key, then, once they are all there, the manifest that makes the entry valid, with the number of shards and, as it is known only then, the size."""
    teacher.write.mode("overwrite").parquet(f"{root}/{key}/shards")
    shards = list((Path(root) / key / "shards").glob("part-*.parquet"))
    manifest |= {"num_batches": len(shards), "shards": entry_parts(root, key), "size_bytes": sum(p.stat().st_size for p in shards)}
    write_json(Path(root) / key / "manifest.json", manifest)
    return manifest


def read_entry(spark: SparkSession, root: str, key: str, window: tuple[int, int] | None = None) -> DataFrame:
    """An entry's positions; a score window is a predicate on the scan, so an entry serves any window."""
    rows = spark.read.parquet(f"{root}/{key}/shards")
    return rows.where((F.col("pos") >= window[0]) & (F.col("pos") < window[1])) if window else rows


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("n_ = 1").drop("n_")
