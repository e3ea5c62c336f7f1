"""Effective bits per weight of checkpoints, from tables of tensor metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.functions import text

#: Bytes of an element; a type that is not listed counts as 0.
WIDTHS = {"F64": 8, "I64": 8, "U64": 8, "F32": 4, "I32": 4, "U32": 4, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "F8_E4M3": 1, "F8_E5M2": 1, "I8": 1, "U8": 1, "BOOL": 1}


def product(shape: str) -> "F.Column":
    return F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, x: a * x)


def with_bytes(tensors: DataFrame) -> DataFrame:
    """Adds nbytes from shape and dtype."""
    spark = tensors.sparkSession
    widths = spark.createDataFrame(list(WIDTHS.items()), "dtype string, width int")
    return tensors.join(F.broadcast(widths), "dtype", "left").withColumn("nbytes", product("shape") * F.coalesce("width", F.lit(0))).drop("width")


def modules(tensors: DataFrame) -> DataFrame:
    """(model, base, weight_*, scales_*, total_bytes): the tensors of each module in one row."""
    kind = F.substring_index("name", ".", -1)
    split = tensors.withColumn("kind_", F.when(kind.isin("weight", "scales", "biases"), kind).otherwise("weight"))
    split = split.withColumn("base", F.when(kind.isin("weight", "scales", "biases"), F.regexp_replace("name", r"\.(weight|scales|biases)$", "")).otherwise(F.col("name")))

    def of(k: str, c: str) -> "F.Column":
        return F.max(F.when(F.col("kind_") == k, F.col(c)))

    return split.groupBy("model", "base").agg(of("weight", "shape").alias("weight_shape"), of("weight", "dtype").alias("weight_dtype"), of("scales", "shape").alias("scales_shape"), F.sum("nbytes").alias("total_bytes"))


def affine_parameters(mods: DataFrame) -> DataFrame:
    """Adds n_params, role, layer, scored. A module with scales has as many input features as its groups hold: the group size is the module's own, else the model's, else 64."""
    group = F.coalesce(F.nullif("own_group", F.lit(0)), F.nullif("default_group", F.lit(0)), F.lit(64))
    rows = F.aggregate(F.slice("weight_shape", F.lit(1), F.greatest(F.size("weight_shape") - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    n = F.when(F.col("scales_shape").isNotNull() & F.col("weight_shape").isNotNull(), rows * F.element_at("scales_shape", -1) * group).when(F.col("weight_shape").isNotNull(), product("weight_shape"))
    return mods.withColumn("n_params", n).withColumn("role", text.role("base")).withColumn("layer", text.layer_index("base")).withColumn("scored", text.is_scored("base"))


def _bpw(size: "F.Column", n: "F.Column") -> "F.Column":
    return size * 8.0 / F.nullif(n, F.lit(0))


def totals(mods: DataFrame) -> DataFrame:
    """One row a model: bytes, parameters, bits per weight, the same for scored weights, and whether it is quantised."""
    scored = F.col("scored")
    out = mods.groupBy("model").agg(
        F.sum("total_bytes").alias("size_bytes"),
        F.sum("n_params").alias("n_params"),
        F.coalesce(F.sum(F.when(scored, F.col("total_bytes"))), F.lit(0)).alias("scored_bytes"),
        F.coalesce(F.sum(F.when(scored, F.col("n_params"))), F.lit(0)).alias("scored_n_params"),
        F.max(F.col("scales_shape").isNotNull() | F.col("default_bits").isNotNull()).alias("quantized"),
    )
    return out.withColumn("effective_bpw", _bpw(F.col("size_bytes"), F.col("n_params"))).withColumn("scored_bpw", _bpw(F.col("scored_bytes"), F.col("scored_n_params"))).withColumn("format", F.when(F.col("quantized"), "mlx-affine").otherwise("mlx"))


def codec_parameters(tensors: DataFrame, codecs: DataFrame, geometry: DataFrame) -> DataFrame:
    """Adds codec and n_params: blocks of the tensor's codec times their weights, or the shape's product without one."""
    joined = tensors.join(F.broadcast(codecs), ["model", "base"], "left").join(F.broadcast(geometry), "codec", "left")
    blocks = F.expr("nbytes div bytes_per_block") * F.col("weights_per_block")
    return joined.withColumn("n_params", F.when(F.col("bytes_per_block") > 0, blocks).otherwise(product("shape")))


def codec_histogram(codecs: DataFrame) -> DataFrame:
    """(model, codec, n) with codecs in lower case, most frequent first within a model, then by name."""
    return codecs.groupBy("model", F.lower("codec").alias("codec")).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(W.partitionBy("model").orderBy(F.desc("n"), "codec")))


def dominant_dtype(tensors: DataFrame) -> DataFrame:
    """(model, dtype): the type with most bytes, ties to the name that sorts first."""
    sums = tensors.groupBy("model", "dtype").agg(F.sum("nbytes").alias("b"))
    return sums.groupBy("model").agg(F.min_by("dtype", F.struct(-F.col("b"), "dtype")).alias("dtype"))


def block_of(name: str) -> "F.Column":
    return F.expr(f"try_cast(nullif(regexp_extract({name}, '^blk[.]([0-9]+)[.]', 1), '') AS INT)")


def draft_blocks(tensors: DataFrame) -> DataFrame:
    """(model, block): decoder blocks that hold a draft head."""
    return tensors.where(F.contains("name", F.lit(".nextn."))).select("model", block_of("name").alias("block")).where("block IS NOT NULL").distinct()


def gguf_scored(tensors: DataFrame) -> DataFrame:
    """The tensors that scoring uses: no block with a draft head, nothing of a picture tower."""
    rest = tensors.withColumn("block", block_of("name")).join(F.broadcast(draft_blocks(tensors)), ["model", "block"], "left_anti")
    return rest.where(~(F.col("name").startswith("v.") | F.col("name").startswith("mm."))).drop("block")


def gguf_totals(tensors: DataFrame, n_params: DataFrame) -> DataFrame:
    """Totals of block-quantised files: scored parameters are the declared number less those of unscored tensors."""
    flagged = tensors.join(gguf_scored(tensors).select("model", "name").withColumn("scored", F.lit(True)), ["model", "name"], "left")
    sums = flagged.groupBy("model").agg(F.sum("nbytes").alias("size_bytes"), F.coalesce(F.sum(F.when(F.col("scored"), F.col("nbytes"))), F.lit(0)).alias("scored_bytes"), F.coalesce(F.sum(F.when(F.col("scored").isNull(), product("shape"))), F.lit(0)).alias("unscored"))
    out = sums.join(n_params, "model").withColumn("scored_n_params", F.greatest(F.col("n_params") - F.col("unscored"), F.lit(0)))
    return out.withColumn("effective_bpw", _bpw(F.col("size_bytes"), F.col("n_params"))).withColumn("scored_bpw", _bpw(F.col("scored_bytes"), F.col("scored_n_params"))).drop("unscored")
