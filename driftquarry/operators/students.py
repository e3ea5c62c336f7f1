"""What a student is on disk: size, parameters, bits per weight and how it was quantised."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftquarry.sources import checkpoints, files

from . import measure

SIDECARS = ("quant-recipe.json", "recipe.json")
_DTYPES = {"F64": "float64", "F32": "float32", "F16": "float16", "BF16": "bfloat16"}


def _codecs(found: dict) -> dict:
    for key in ("quantization", "quantization_config"):
        block = found.get(key)
        if isinstance(block, dict) and isinstance(block.get("per_tensor"), dict) and block["per_tensor"]:
            return block["per_tensor"]
    return {}


def _entry(row: dict, path: str, fmt: str, quantization: dict, size: int) -> dict:
    return {"path": path, "format": fmt, "size_bytes": size, "effective_bpw": row["effective_bpw"], "n_params": row["n_params"], "quantization": quantization, "scored_bpw": row["scored_bpw"], "scored_n_params": row["scored_n_params"], "scored_bytes": row["scored_bytes"]}


def affine_modules(tensors: DataFrame, quant: dict) -> DataFrame:
    """Modules with a weight, their parameters by the group sizes of the config: a module's own, else the model's."""
    own = [(base, v.get("group_size")) for base, v in quant.items() if isinstance(v, dict)]
    mods = measure.modules(tensors).where("weight_shape IS NOT NULL")
    mods = mods.join(F.broadcast(tensors.sparkSession.createDataFrame(own, "base string, own_group int")), "base", "left")
    mods = mods.withColumn("default_group", F.lit(quant.get("group_size")).cast("int")).withColumn("default_bits", F.lit(quant.get("bits")).cast("int"))
    return measure.affine_parameters(mods)


def measured(spark: SparkSession, path: str) -> dict:
    """The `student` object of a record, from headers: an affine, per-tensor or unquantised checkpoint folder, or a block-quantised file."""
    if path.endswith(".gguf"):
        tensors = checkpoints.gguf_table(spark, [path])
        declared = tensors.groupBy("model").agg(F.sum(measure.product("shape")).alias("n_params"))
        row = measure.gguf_totals(tensors, declared).first().asDict()
        codecs = {r["codec"]: r["n"] for r in measure.codec_histogram(tensors.select("model", "codec")).orderBy("place").collect()}
        arch = tensors.agg(F.max("arch")).first()[0]
        return _entry(row, path, "gguf", {"kind": "gguf", "arch": arch, "codecs": codecs}, sum(Path(s).stat().st_size for s in checkpoints.gguf_shards(path)))
    found = checkpoints.config(path)
    size = sum(f.stat().st_size for f in Path(path).glob("*.safetensors"))
    tensors = checkpoints.safetensors_table(spark, [path])
    per_tensor = _codecs(found)
    if per_tensor:
        named = tensors.withColumn("base", F.regexp_replace("name", r"\.weight$", ""))
        codecs = spark.createDataFrame([(path, b, c) for b, c in per_tensor.items()], "model string, base string, codec string")
        geometry = spark.createDataFrame([(n, b, w) for n, w, b in checkpoints.BLOCKS.values() if w > 1], "codec string, bytes_per_block long, weights_per_block long")
        rows = measure.codec_parameters(named, codecs, geometry).withColumn("scored", measure.text.is_scored("base"))
        row = measure.totals(rows.select("model", F.col("nbytes").alias("total_bytes"), "n_params", "scored", F.lit(None).cast("array<long>").alias("scales_shape"), F.lit(None).cast("int").alias("default_bits"))).first().asDict()
        order = measure.codec_histogram(codecs).orderBy("place").collect()
        return _entry(row, path, "mlx-kquant", {"kind": "kquant", "codecs": {r["codec"]: r["n"] for r in order}}, size)
    quant = found.get("quantization") if isinstance(found.get("quantization"), dict) else {}
    row = measure.totals(affine_modules(tensors, quant)).first().asDict()
    if row["format"] == "mlx-affine":
        kind = {"kind": "affine", "bits": quant.get("bits"), "group_size": quant.get("group_size"), "mode": quant.get("mode") or "affine"}
    else:
        dtype = measure.dominant_dtype(tensors).first()["dtype"]
        kind = {"kind": "none", "dtype": _DTYPES.get(dtype, dtype.lower())}
    return _entry(row, path, row["format"], kind, size)


def unmeasured(path: str) -> dict:
    """The `student` object where there are no files to measure: what isn't known is null."""
    return {"path": path, "format": "gguf" if path.endswith(".gguf") else "mlx", "size_bytes": None, "effective_bpw": None, "n_params": None, "quantization": {"kind": None}}


def recipe(spark: SparkSession, path: str) -> dict | None:
    return files.provenance(spark, path, list(SIDECARS)) or None
