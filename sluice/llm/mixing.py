"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, ordered_index, partitions, table

#: Up to so many sources, their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Rows of a source that one window partition holds at most, about; small inputs are cut further, by the partitions.
BUCKET_ROWS = 20_000


def fill_levels(sources: DataFrame, total: float, cap: float) -> float:
    """The water level: each source gets min(weight * level, cap * size), together ``total``.

    Sources above their cap are clamped, and the excess is shared again by weight until none is above.
    Each round takes three sums over ``sources`` (source_size, weight); clamped sources never come back.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("source_size") * cap
        free, held, n = sources.agg(
            F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("source_size") * cap)), F.count(F.when(over, 1))
        ).first()
        if n == clamped or not free:
            return level if free else math.inf
        level, clamped = (total - (held or 0.0)) / free, n


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, repeats, taken.

    Sources in code point order, null last, take the weights in turn and share all words. A document of a source
    that is repeated r times appears floor(r) times; the fraction is a systematic sample in a seeded order: a
    document is taken once more while the words before its middle are below the fraction's share. So a source's
    words miss its target by half a document at most.

    Null text: size 0. Null source: a source of its own. Null or repeated doc_id: rows count one by one; equal ids are
    ordered by size. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.save(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = ordered_index(totals, scratch, "sources", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = scratch.save(ranked.withColumn("weight", weight), "ranked")
    n_sources, n_rows, total = sources.agg(F.count("*"), F.sum("n"), F.sum("source_size")).first()
    level = fill_levels(sources, float(total or 0), float(cap))
    share = F.least(F.col("weight") * F.lit(level), F.col("source_size") * float(cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        sources.withColumn("target", F.when(F.col("source_size") > 0, share).otherwise(0.0))
        .withColumn("whole", F.floor(rate + 1e-12))
        .withColumn("rest", F.greatest(F.lit(0.0), (rate - F.col("whole")) * F.col("source_size")))
        .select(F.col("source").alias("__source"), "idx", "source_size", "target", "whole", "rest")
    )
    buckets = max(4 * partitions(spark), -(-(n_rows or 0) // BUCKET_ROWS))
    part = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * buckets), F.lit(buckets - 1))  # ranges of the hash: the order is that of h alone
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    dealt = sizes.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("bucket", part)
    before = W.partitionBy("idx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
        .select("idx", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    )
    inside = W.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("start") + F.col("seen") - F.col("size") / 2
    extra = F.when((F.col("size") > 0) & (middle < F.col("rest")), 1).otherwise(0)
    return (
        dealt.withColumn("seen", F.sum("size").over(inside))
        .join(starts, ["idx", "bucket"])
        .withColumn("repeats", (F.col("whole") + extra).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of equal doc_id get the most repeats that one of them has.

    Null text and null source as in ``mix``. An empty table stays empty; columns may have any names, and all are returned.
    """
    key, times, copy = fresh(docs.columns, "__id", "__n", "__copy")
    taken = mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("repeats").alias(times)).where(F.col(times) > 0)
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(key)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[f"`{c}`"] for c in docs.columns])
