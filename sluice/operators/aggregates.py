"""Aggregates, with the modifiers ``distinct`` and ``unique`` (values that occur exactly once in the group)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import take

Side = Callable[[DataFrame, list[str]], DataFrame]


@dataclass
class Agg:
    """An output column: a Column over a group's rows, or a side table (keys..., name) that is aggregated by itself."""

    name: str
    column: Column | None = None
    side: Side | None = None
    default: object = None
    #: The side table has a row for each group that the rows have.
    whole: bool = False


def unique(name: str, value: Column, make: Callable[[Column], Column], default: object = None) -> Agg:
    """An aggregate over the values seen once in a group: values are counted first, with partial aggregation."""

    def side(df: DataFrame, keys: list[str]) -> DataFrame:
        each = df.select(*keys, value.alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
        return each.groupBy(*keys).agg(make(F.when(F.col("__c") == 1, F.col("__v"))).alias(name))  # a null value stays null

    return Agg(name, side=side, default=default, whole=True)


def row_map(name: str, k: Column, v: Column, order: list[Column]) -> Agg:
    """A map from k to its last v; rows that lack either are skipped."""

    def side(df: DataFrame, keys: list[str]) -> DataFrame:
        last = df.where(k.isNotNull() & v.isNotNull()).groupBy(*keys, k.alias("__k")).agg(F.max_by(v, F.struct(*order)).alias("__v"))
        return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__v")))).alias(name))

    return Agg(name, side=side)


def taken(name: str, value: Column, order: list[Column], n: int, m: int | None = None, modifier: str = "") -> Agg:
    """The first n (last -n) values of a group, of these the first m (last -m), as a list of that length at most.

    modifier: of equal values only the first counts (distinct), or only values that occur once (unique).
    """

    def side(df: DataFrame, keys: list[str]) -> DataFrame:
        slim = df.select(*keys, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o"), value.alias("__v")).where(F.col("__v").isNotNull())
        if modifier:
            slim = slim.groupBy(*keys, "__v").agg(F.min("__o").alias("__o"), F.count("*").alias("__c"))
            slim = (slim.where("__c = 1") if modifier == "unique" else slim).drop("__c")
        some = take(slim, keys, ["__o"], n, m)
        return some.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias(name))

    return Agg(name, side=side)


def aggregate(df: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """All aggregates by the keys; side tables are joined on them. Partial aggregation precedes every shuffle."""
    sides = [a for a in aggs if a.side is not None]
    plain = [a.column.alias(a.name) for a in aggs if a.side is None]
    if len(sides) == 1 and not plain and sides[0].whole:
        return sides[0].side(df, keys)
    out = df.groupBy(*keys).agg(*(plain or [F.count("*").alias("__n")]))
    for k, a in enumerate(sides):
        side = a.side(df, keys)
        if keys:
            side = side.select(*[F.col(c).alias(f"__{k}_{i}") for i, c in enumerate(keys)], a.name)
            on = [F.col(c).eqNullSafe(F.col(f"__{k}_{i}")) for i, c in enumerate(keys)]
            out = out.join(side, on, "left").drop(*[f"__{k}_{i}" for i in range(len(keys))])
        else:
            out = out.crossJoin(side)  # one row each
        if a.default is not None:
            out = out.withColumn(a.name, F.coalesce(a.name, F.lit(a.default)))
    return out.drop("__n")
