"""The engine: named sources, settings, extensions, and queries in the dialect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .functions import FUNCTIONS, register_udfs
from .plans.lowering import Lowering, Result
from .plans.parser import Query, With, parse


@dataclass
class OutputColumn:
    alias: str
    origin: str
    kind: str


class Engine:
    """``register`` sources, then ``sql``.

    order_by names the columns in whose order a source's rows arrive, time the column of event time. Settings come
    from here and from hints; ``mode`` is compat (the dialect's own semantics) or ansi.
    """

    def __init__(self, spark: SparkSession, **settings) -> None:
        self.spark, self.settings = spark, settings
        self.tables: dict[str, Result] = {}
        self.scalars: dict[str, Callable] = {}
        self.aggregates: dict[str, Callable] = {}
        self.sources: dict[str, Callable] = {}
        self.expansions: dict[str, Callable[..., str]] = {}
        self.groupings: dict[str, Callable] = {}
        self.distincts: dict[str, Callable] = {}
        self.properties: list[Callable] = []
        register_udfs(spark)

    def register(self, name: str, df: DataFrame, order_by: list[str] | None = None, time: str | None = None, late: str = "10 minutes") -> Engine:
        """late: how long a stream waits for rows of an earlier time."""
        if df.isStreaming and time:
            df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
        order = order_by or [c for c in df.columns if c == "__ord"] or df.columns[:1]
        self.tables[name] = Result(df, list(order), time)
        return self

    def lookup(self, name: str) -> Result:
        if name in self.tables:
            return self.tables[name]
        if self.spark.catalog.tableExists(name):
            df = self.spark.table(name)
            return Result(df, df.columns[:1])
        raise QueryError("unknown_name", "no such source", expression=name)

    # extensions
    def scalar(self, name: str, build: Callable[..., str]) -> Engine:
        """A scalar function as a macro over SQL texts; it may name a registered UDF."""
        self.scalars[name.lower()] = build
        return self

    def udf(self, name: str, f) -> Engine:
        self.spark.udf.register(f"sluice_{name.lower()}", f)
        return self.scalar(name, lambda *a: f"sluice_{name.lower()}({', '.join(a)})")

    def aggregate(self, name: str, build: Callable) -> Engine:
        """An aggregate from Columns to a Column, such as a grouped pandas UDF."""
        self.aggregates[name.lower()] = build
        return self

    def table_function(self, name: str, build: Callable[..., DataFrame], order_by: list[str] | None = None) -> Engine:
        def made(*args):
            df = build(*args)
            return Result(df, order_by or df.columns[:1])

        self.sources[name.lower()] = made
        return self

    def expansion(self, name: str, build: Callable[..., str]) -> Engine:
        """A row expansion: a macro over SQL texts that makes a list, of which each element becomes a row."""
        self.expansions[name.lower()] = build
        return self

    def grouping(self, name: str, build: Callable[[DataFrame, list[str], list[str], list[str], str], DataFrame]) -> Engine:
        """A group key: build(rows, keys so far, columns of arrival, constant arguments, name) adds the column ``name``."""
        self.groupings[name.lower()] = build
        return self

    def distinct(self, name: str, build: Callable[[DataFrame, list[str], list[str]], DataFrame]) -> Engine:
        """What ``distinct`` does under the hint distinctBy(name): build(rows, their columns, columns of arrival)."""
        self.distincts[name] = build
        return self

    def distinct_by(self, name: str) -> Callable:
        if name not in self.distincts:
            raise QueryError("invalid_option", "no such distinct", expression=name, suggestion=f"one of {sorted(self.distincts)}")
        return self.distincts[name]

    def property(self, build: Callable) -> Engine:
        """Access to properties: build(SQL text, its type, name of the property) gives SQL text, or None to pass on."""
        self.properties.append(build)
        return self

    # queries
    def sql(self, text: str, params=(), **settings) -> DataFrame:
        low = Lowering(self, params, self.settings | settings)
        try:
            out = low.query(parse(text)).df
            return out.drop(*[c for c in out.columns if c.startswith("__")])
        finally:
            for v in low.views:
                self.spark.catalog.dropTempView(v)

    def select_columns(self, text: str) -> list[OutputColumn]:
        """Alias, origin and type of each output column."""
        q = parse(text)
        q = q.body if isinstance(q, With) else q
        items = {a: e for e, a in q.items} if isinstance(q, Query) else {}
        origin = lambda n: ".".join(items[n][1]) if n in items and items[n][0] == "column" else n
        return [OutputColumn(f.name, origin(f.name), f.dataType.simpleString()) for f in self.sql(text).schema]

    @staticmethod
    def functions() -> list[str]:
        return sorted(FUNCTIONS)
