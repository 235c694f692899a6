"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, partitions, table


#: Characters of a text in the keys that splitters are sampled from.
LEAD = 64


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are sorted as bytes: sampled splitters deal (first LEAD characters, hash, part) out by range, so that the
    sample stays small however long the texts; each range is sorted externally with the full text behind, and the
    window compares neighbouring full texts. A text that holds over 1/(4 * partitions) of the rows, of which
    there are 4 * partitions at most, is cut into parts by doc_id first; the parts' heads, eight per partition at
    most, then meet by full comparison again.

    Null text counts as empty. The largest doc_id stays, null ids sort below all others; of rows with equal text and
    equal doc_id one stays. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch, p = Scratch(spark, "exact"), partitions(spark)
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", norm.alias("norm"), F.xxhash64(norm).alias("h"))
    n = docs.count()
    limit = max(8, n // (4 * p))
    heavy = rows.groupBy("h").count().where(F.col("count") > limit).collect()  # 4 * p hashes at most
    parts = spark.createDataFrame([(r[0], -(-r[1] // limit)) for r in heavy], "h long, n_parts long")
    rows = rows.join(F.broadcast(parts), "h", "left")
    part = F.when(F.col("n_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "doc_id"), "n_parts") + 1)
    lead = F.substring("norm", 1, LEAD)
    placed = rows.select("doc_id", "norm", "h", lead.alias("lead"), part.alias("part")).repartitionByRange(p, "lead", "h", "part")
    w = W.partitionBy("lead", "h", "norm", "part").orderBy(F.desc_nulls_last("doc_id"))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = placed.select(
        "doc_id", "part", F.row_number().over(w).alias("rn"), F.max("doc_id").over(whole).alias("keep_id"),
        F.count("*").over(whole).alias("group_size"), F.sha2("norm", 256).alias("text_sha256"), "norm",
    )
    local = local.withColumn("head", F.when((F.col("rn") == 1) & (F.col("part") > 0), F.col("norm"))).drop("norm")
    local = scratch.save(local, "local")
    over = W.partitionBy("head")
    heads = local.where(F.col("head").isNotNull()).select(
        F.col("text_sha256").alias("s"), F.col("part").alias("q"), F.max("keep_id").over(over).alias("top"), F.sum("group_size").over(over).alias("all")
    )
    top = F.when(F.col("part") > 0, F.col("top")).otherwise(F.col("keep_id"))
    joined = local.join(F.broadcast(heads), (F.col("text_sha256") == F.col("s")) & (F.col("part") == F.col("q")), "left")
    return joined.select(
        "doc_id", top.alias("keep_id"), F.coalesce("all", "group_size").alias("group_size"),
        ((F.col("rn") == 1) & F.col("keep_id").eqNullSafe(top)).alias("kept"), "text_sha256",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
