"""Windows as group keys: by time, by count, sliding, and by count or timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import index_in


def tumbling_time(df: DataFrame, at: Column, span_ms: int, name: str, slide_ms: int | None = None) -> DataFrame:
    """name: the start of each window that holds the row."""
    ms = lambda n: f"{n} milliseconds"
    return df.withColumn("__w", F.window(at.cast("timestamp"), ms(span_ms), ms(slide_ms or span_ms))).withColumn(name, F.col("__w.start")).drop("__w")


def count_windows(df: DataFrame, keys: list, order: list, size: int, name: str, skip: int | None = None) -> DataFrame:
    """name: number of each window of ``size`` rows that holds the row; windows start every ``skip`` rows."""
    i = F.col("__i") - 1
    out = index_in(df, keys, order, "__i")
    if skip is None or skip == size:
        return out.withColumn(name, F.floor(i / size)).drop("__i")
    first, last = F.greatest(F.lit(0), F.ceil((i - size + 1) / skip)), F.floor(i / skip)
    ids = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    return out.withColumn(name, F.explode(ids)).drop("__i")


def count_or_timeout(df: DataFrame, keys: list[str], order: list[str], at: str, most: int, timeout_ms: int, name: str) -> DataFrame:
    """name: number of the window; a window closes after ``most`` rows or ``timeout_ms`` after its first row.

    An ordered fold: rows come sorted within their group, in Arrow batches, so that a group is never held whole.
    """
    marked = df.withColumn("__ms", F.unix_millis(F.col(at).cast("timestamp")))
    group = keys or ["__one"]
    if not keys:
        marked = marked.withColumn("__one", F.lit(1))
    placed = marked.repartition(*group).sortWithinPartitions(*group, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window, count, opened = None, -1, 0, 0
        for b in batches:
            ids = []
            for k, ms in zip(zip(*(b[c] for c in group)), b["__ms"]):
                if k != key:
                    key, window, count = k, -1, most
                if count >= most or ms >= opened + timeout_ms:
                    window, count, opened = window + 1, 0, ms
                count += 1
                ids.append(window)
            b[name] = ids
            yield b

    schema = T.StructType([*placed.schema.fields, T.StructField(name, T.LongType())])
    return placed.mapInPandas(fold, schema).drop("__ms", "__one")


def dense(counts: DataFrame, at: str, span_ms: int, fill: dict[str, object], keys: list[str] | None = None) -> DataFrame:
    """Windows without rows between the first and the last, for each key; columns of fill get its values."""
    keys = keys or []
    ends = counts.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    step = F.expr(f"make_dt_interval(0, 0, 0, {span_ms / 1000})")
    slots = ends.select(F.explode(F.sequence("lo", "hi", step)).alias(at))
    if keys:
        slots = counts.select(*keys).distinct().crossJoin(F.broadcast(slots))  # a row per window: bounded by the time range
    return slots.join(counts, [at, *keys], "left").fillna(fill)
