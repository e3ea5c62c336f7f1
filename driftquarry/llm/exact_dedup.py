"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside groups, keep the smallest id.

Plan. The first pass shuffles only (hash, count): texts stay where they are. Texts of the few hashes
that occur more than once are then grouped by (hash, text), with a partial aggregation on the map side,
so neither unique texts nor thousands of copies of one text travel. The list of repeated hashes is
broadcast if it is small enough (checked) and joined by shuffle beyond that.

Defined cases. A null text has no content: such rows are all kept, with a null hash. Empty texts are
copies of each other. A null id sorts after all others, so such a row stays only where its text has no
other copy with an id. Repeated rows are copies. Ties between equal ids are broken by a hash of the row.
Further columns are carried unchanged, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, other_names, small_or_shuffled


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without later copies; same columns."""
    n = other_names(docs, "content_hash", "row_", "tie_", "n_")
    key, row, tie, count = n["content_hash"], n["row_"], n["tie_"], n["n_"]
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    hashed = docs.withColumn(key, F.unhex(F.md5(text.cast("binary"))))
    repeated = checkpointed(hashed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count)).where(F.col(count) > 1).select(key))
    repeated = small_or_shuffled(repeated)
    single = hashed.join(repeated, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(ident.isNull(), ident, F.xxhash64(*plain))
    # The text is a key, so bytes are compared within a hash; rows carry all else.
    rest = [c for c in docs.columns if c != text_col]
    copies = (
        hashed.join(repeated, key, "left_semi")
        .withColumn(row, F.struct(*[F.col(f"`{c}`") for c in rest]))
        .withColumn(tie, order)
        .groupBy(key, text)
        .agg(F.min_by(row, tie).alias(row))
    )
    return single.unionByName(copies.select(*[F.col(f"`{c}`") if c == text_col else F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns]))


def kept_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash) of the documents that stay, without their texts.

    Ids and hashes are all that leaves the single documents, so the result is one grouping of small
    rows; only texts of repeated hashes are compared.
    """
    hashed = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"))
    groups = hashed.where(F.col("h").isNotNull()).groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    groups = checkpointed(groups)
    repeated = small_or_shuffled(groups.where("n > 1").select("h"))
    copies = hashed.join(repeated, "h", "left_semi").groupBy("h", "text").agg(F.min("doc_id").alias("doc_id"))
    out = groups.where("n = 1").select("doc_id", "h").unionByName(copies.select("doc_id", "h")).unionByName(hashed.where(F.col("h").isNull()).select("doc_id", "h"))
    return out.select("doc_id", F.lower(F.hex("h")).alias("content_hash"))
