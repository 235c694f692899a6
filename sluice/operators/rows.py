"""Row numbers, sorting, distinct rows and limits. ``order`` is the list of columns of arrival.

Whatever follows the order of all rows works in ranges: rows are dealt by splitters over all order columns, so that a
range is a task's share whatever the first column looks like, and what passes from one range to the next is a row
per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..errors import QueryError

#: Rows of the sample from which splitters are taken, per range.
SAMPLE = 32


def columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def in_ranges(df: DataFrame, order: list, name: str = "__p") -> DataFrame:
    """Add the number of each row's range; ranges follow each other in ``order``, and rows of equal order share one.

    Splitters come from the rows with the smallest hashes of their order columns: a sample that every run repeats, of a
    bounded number of rows, and lazy as the rest of the plan. They are the value of a sub-query, not a column of each
    row, and are picked and searched by functions over lists: a plan of the same few expressions for any number of ranges.
    """
    steps = [1]
    while 2 * steps[0] < 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        steps.insert(0, 2 * steps[0])
    parts = 2 * steps[0]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns(order))])
    sample = df.select(key.alias("k")).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(parts * SAMPLE)
    held = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))  # one row of parts * SAMPLE order keys
    at = lambda i: F.greatest(F.floor(F.size("s") * i / parts), F.lit(1)).cast("int") - 1
    cuts = held.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("s", at(i)))).scalar()

    right = lambda p, step: F.get("__cuts", p + step - 1) < key
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, step: F.when(right(p, step), p + step).otherwise(p))
    return df.withColumn("__cuts", cuts).select(*[f"`{c}`" for c in df.columns if c != name], found.alias(name))


def carried(ranged: DataFrame, last: list[Column], make: list[Column]) -> DataFrame:
    """Per range ``__q`` what the ranges before it hand over. last: aggregates of a range; make: columns over all before."""
    return ranged.groupBy(F.col("__p").alias("__q")).agg(*last).select("__q", *make)


def before() -> WindowSpec:
    """Over all earlier ranges, a row each."""
    return W.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)


def sequenced(df: DataFrame, order: list, index: str | None = None, value: Column | None = None, previous: str | None = None) -> DataFrame:
    """Add the 1-based number of each row in ``order`` as ``index``, and the value of the row before as ``previous``.

    Both are taken inside ranges; a range adds the sizes of the ranges before it, and its first row takes the value of the
    last row before it.
    """
    by = columns(order)
    placed = in_ranges(df if value is None else df.withColumn("__v", value), order)
    inside = W.partitionBy("__p").orderBy(*by)
    number = F.row_number().over(inside)
    last, make = [F.count("*").alias("n")], [F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("__start")]
    if value is not None:
        last.append(F.max_by(F.struct("__v"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])).alias("v"))
        make.append(F.last("v", ignorenulls=True).over(before()).alias("__carry"))
    ends = carried(placed, last, make)
    out = placed.withColumn("__n", number)
    if value is not None:
        out = out.withColumn("__lag", F.lag("__v").over(inside))
    out = out.join(F.broadcast(ends), F.col("__p") == F.col("__q"), "left")  # a row per range; each has one
    if value is not None:
        out = out.withColumn(previous, F.when(F.col("__n") == 1, F.col("__carry.__v")).otherwise(F.col("__lag"))).drop("__v", "__lag", "__carry")
    if index is not None:
        out = out.withColumn(index, (F.col("__start") + F.col("__n")).cast("bigint"))
    return out.drop("__p", "__q", "__n", "__start")


def global_index(df: DataFrame, order: list, name: str = "__index") -> DataFrame:
    """1-based number of each row in ``order`` over all rows."""
    return sequenced(df, order, name)


def index_in(df: DataFrame, keys: list, order: list, name: str = "__index") -> DataFrame:
    """1-based number of each row in its group, or over all rows without keys."""
    if not keys:
        return global_index(df, order, name)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def previous(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Add the value of the row before in ``order``, null for the first."""
    return sequenced(df, order, None, value, name)


def index_and_elapsed(df: DataFrame, order: list, at: Column, index: str, name: str) -> DataFrame:
    """Add the number of each row in ``order`` and the milliseconds since the row before."""
    ms = F.unix_millis(at.cast("timestamp"))
    return sequenced(df, order, index, ms, "__ms").withColumn(name, ms - F.col("__ms")).drop("__ms")


def take(df: DataFrame, keys: list, order: list, n: int, m: int | None = None) -> DataFrame:
    """The first n rows of each group, the last -n if negative; of these the first m, or the last -m."""
    down = [F.col(c).desc() if isinstance(c, str) else c.desc() for c in order]

    def cut(x: DataFrame, k: int) -> DataFrame:
        if not keys:
            return x.orderBy(*(order if k >= 0 else down)).limit(abs(k))
        w = W.partitionBy(*keys).orderBy(*(order if k >= 0 else down))
        return x.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= abs(k)).drop("__rank")

    out = cut(df, n)
    return out if m is None else cut(out, m)


def distinct_on(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return take(df, keys, order, 1)


def top(df: DataFrame, order: list[Column], offset: int, limit: int | None) -> DataFrame:
    if limit is not None and limit < 0 or offset < 0:
        raise QueryError("arguments", "a limit can't be negative")
    out = df.orderBy(*order) if order else df
    if limit is not None:
        out = out.limit(offset + limit)
    return out.offset(offset) if offset else out


def window_sort(df: DataFrame, arrival: list, order: list, size: int, name: str = "__block") -> DataFrame:
    """Sorted only inside consecutive blocks of ``size`` rows."""
    indexed = global_index(df, arrival, "__i")
    blocks = indexed.withColumn(name, F.floor((F.col("__i") - 1) / size)).drop("__i")
    return blocks.orderBy(name, *order)


def guard(df: DataFrame, most: int, what: str) -> DataFrame:
    """Raise, when the rows are read, if df has more than ``most``."""
    n = df.limit(most + 1).agg(F.count("*").alias("__n"))
    why = F.raise_error(F.lit(f"resource_limit: {what} has more than {most} rows"))
    return df.crossJoin(F.broadcast(n)).where(F.when(F.col("__n") > most, why.cast("boolean")).otherwise(True)).drop("__n")  # one row
