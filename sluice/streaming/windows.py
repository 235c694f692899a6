"""Windows over streams. State is bounded per key: the rows of an open window, a counter and an opening time, or one row per source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(stream: DataFrame, at: str, span: str, aggs: list[Column], keys: list[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding event-time windows; rows later than ``late`` are dropped, closed windows are emitted."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.window(at, span, slide or span), *keys).agg(*aggs)


def _to_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def counted(stream: DataFrame, keys: list[str], schema: str, size: int, close: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> DataFrame:
    """Count windows per key: ``close`` turns each full window of ``size`` rows into output rows.

    The state holds the rows of the open window, fewer than ``size``, as typed Arrow data.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _from_bytes(state.get[0]) if state.exists else pd.DataFrame(columns=columns)
        for b in batches:
            rows = pd.concat([held, b[columns]], ignore_index=True) if len(held) else b[columns].reset_index(drop=True)
            full = len(rows) // size * size
            for at in range(0, full, size):
                yield close(rows.iloc[at : at + size])
            held = rows.iloc[full:].reset_index(drop=True)
        state.update((_to_bytes(held),))

    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def count_or_timeout(stream: DataFrame, keys: list[str], value: str, most: int, timeout_ms: int) -> DataFrame:
    """Per key and window: key columns, n, total; a window closes after ``most`` rows or ``timeout_ms`` of processing time."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in keys), "n bigint, total double"])
    names = [f.name for f in stream.schema if f.name in keys]
    step = fold_or_timeout(keys, names, value, most, timeout_ms)
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "n bigint, total double, opened bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fold_or_timeout(keys: list[str], names: list[str], value: str, most: int, timeout_ms: int) -> Callable:
    """State step of ``count_or_timeout``. Spark forgets a key's timeout at every call, so each call sets what is left of it."""

    def row(key: tuple, n: int, total: float) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | {"n": n, "total": total}])[[*names, "n", "total"]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, _ = state.get
            state.remove()
            yield row(key, n, total)
            return
        now = state.getCurrentProcessingTimeMs()
        n, total, opened = state.get if state.exists else (0, 0.0, now)
        if n and now >= opened + timeout_ms:  # rows come before the timeout was told
            yield row(key, n, total)
            n, total, opened = 0, 0.0, now
        for b in batches:
            for x in b[value]:
                n, total = n + 1, total + (float(x) if x == x and x is not None else 0.0)
                if n == most:
                    yield row(key, n, total)
                    n, total, opened = 0, 0.0, now
        if n:
            state.update((n, total, opened))
            state.setTimeoutDuration(max(1, opened + timeout_ms - now))
        elif state.exists:
            state.remove()

    return step


def keep_latest(key: str, sources: list[str]) -> Callable:
    """State step of ``combine_latest``: one JSON text per source."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = list(state.get) if state.exists else [None] * len(sources)
        for b in batches:
            out = []
            for s, x in zip(b["__source"], b["__row"]):
                latest[sources.index(s)] = x
                if all(v is not None for v in latest):
                    out.append((k[0], *latest))
            if out:
                yield pd.DataFrame(out, columns=[key, *sources])
        state.update(tuple(latest))

    return step


def combine_latest(streams: dict[str, DataFrame], key: str) -> DataFrame:
    """Per key, a row on each arrival once all streams have sent one: the latest row of each, as JSON text."""
    names = list(streams)
    both = None
    for name, s in streams.items():
        one = s.select(F.col(key).cast("string").alias(key), F.lit(name).alias("__source"), F.to_json(F.struct("*")).alias("__row"))
        both = one if both is None else both.unionByName(one)
    columns = ", ".join(f"`{n}` string" for n in names)
    return both.groupBy(key).applyInPandasWithState(keep_latest(key, names), f"`{key}` string, {columns}", columns, "append", GroupStateTimeout.NoTimeout)


def sort_batches(stream: DataFrame, order: list[Column], write: Callable[[DataFrame, int], None]):
    """A stream writer that hands each micro-batch over sorted; a stream as a whole has no order."""
    return stream.writeStream.foreachBatch(lambda df, n: write(df.orderBy(*order), n))
