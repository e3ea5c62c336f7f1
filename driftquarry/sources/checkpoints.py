"""Checkpoints as tables of tensors, from headers alone: a file's header is read, its data never is.

Paths have to be visible to all executors, as a shared file system's are; the heads of files are parsed there.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import files

#: Block formats by their number in a file: name, weights a block, bytes a block.
BLOCKS = {
    0: ("f32", 1, 4), 1: ("f16", 1, 2), 2: ("q4_0", 32, 18), 3: ("q4_1", 32, 20), 6: ("q5_0", 32, 22), 7: ("q5_1", 32, 24), 8: ("q8_0", 32, 34), 9: ("q8_1", 32, 36),
    10: ("q2_k", 256, 84), 11: ("q3_k", 256, 110), 12: ("q4_k", 256, 144), 13: ("q5_k", 256, 176), 14: ("q6_k", 256, 210), 15: ("q8_k", 256, 292),
    16: ("iq2_xxs", 256, 66), 17: ("iq2_xs", 256, 74), 18: ("iq3_xxs", 256, 98), 19: ("iq1_s", 256, 50), 20: ("iq4_nl", 32, 18), 21: ("iq3_s", 256, 110), 22: ("iq2_s", 256, 82), 23: ("iq4_xs", 256, 136),
    24: ("i8", 1, 1), 25: ("i16", 1, 2), 26: ("i32", 1, 4), 27: ("i64", 1, 8), 28: ("f64", 1, 8), 29: ("iq1_m", 256, 56), 30: ("bf16", 1, 2), 39: ("mxfp4", 32, 17),
}
_SPLIT = re.compile(r"^(.*)-(\d{5})-of-(\d{5})\.gguf$")


def safetensors_shards(directory: str) -> list[str]:
    """The files of a checkpoint: those that its index names, else the single one."""
    root = Path(directory)
    index, single = root / "model.safetensors.index.json", root / "model.safetensors"
    if index.exists():
        return [str(root / n) for n in sorted(set(json.loads(index.read_text())["weight_map"].values()))]
    if single.exists():
        return [str(single)]
    raise FileNotFoundError(f"{directory} holds no safetensors")


def gguf_shards(path: str) -> list[str]:
    """All parts of a split file, or the file; a missing part is an error."""
    m = _SPLIT.match(path)
    parts = [f"{m[1]}-{i:05}-of-{m[3]}.gguf" for i in range(1, int(m[3]) + 1)] if m else [path]
    lost = [p for p in parts if not Path(p).exists()]
    if lost:
        raise FileNotFoundError(f"missing: {', '.join(lost)}")
    return parts


def read_safetensors_header(f: BinaryIO) -> dict:
    (n,) = struct.unpack("<Q", f.read(8))
    head = json.loads(f.read(n))
    head.pop("__metadata__", None)
    return head


class _Head:
    """The head of a file as bytes that are read as they are asked for."""

    def __init__(self, f: BinaryIO):
        self.f, self.have = f, bytearray()

    def parse(self) -> tuple[dict, list[tuple[str, list[int], int, int]]]:
        while True:
            more = self.f.read(max(1 << 20, len(self.have)))
            self.have += more
            try:
                return files.gguf_header(bytes(self.have))
            except (struct.error, IndexError, UnicodeDecodeError):
                if not more:
                    raise ValueError("the file ends within its head") from None


def safetensors_table(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(model, shard, name, dtype, shape, nbytes) of the tensors of checkpoints."""
    shards = [(d, p) for d in directories for p in safetensors_shards(d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for model, path in zip(batch["model"], batch["path"]):
                with open(path, "rb") as f:
                    head = read_safetensors_header(f)
                rows += [(model, Path(path).name, name, t["dtype"], [int(x) for x in t["shape"]], int(t["data_offsets"][1] - t["data_offsets"][0])) for name, t in head.items()]
            yield pd.DataFrame(rows, columns=["model", "shard", "name", "dtype", "shape", "nbytes"])

    paths = spark.createDataFrame(shards, "model string, path string").repartition(max(1, len(shards)))
    return paths.mapInPandas(run, "model string, shard string, name string, dtype string, shape array<long>, nbytes long")


def gguf_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model, shard, arch, name, codec, shape, nbytes) of the tensors of block-quantised files, all parts of each."""
    shards = [(p, s) for p in paths for s in gguf_shards(p)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for model, path in zip(batch["model"], batch["path"]):
                with open(path, "rb") as f:
                    meta, tensors = _Head(f).parse()
                for name, shape, kind, _ in tensors:
                    codec, weights, size = BLOCKS.get(kind, (f"type{kind}", 1, 0))
                    n = 1
                    for x in shape:
                        n *= x
                    rows.append((model, Path(path).name, meta.get("general.architecture"), name, codec, [int(x) for x in shape], n // weights * size))
            yield pd.DataFrame(rows, columns=["model", "shard", "arch", "name", "codec", "shape", "nbytes"])

    found = spark.createDataFrame(shards, "model string, path string").repartition(max(1, len(shards)))
    return found.mapInPandas(run, "model string, shard string, arch string, name string, codec string, shape array<long>, nbytes long")


def config(path: str) -> dict:
    """A checkpoint's config.json, of a folder or given as the file; empty if there is none or it isn't an object."""
    at = Path(path) / "config.json" if Path(path).is_dir() else Path(path)
    try:
        found = json.loads(at.read_text()) if at.suffix == ".json" else {}
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}
