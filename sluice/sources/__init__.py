"""Sources of rows, and sinks: everything that Spark reads and writes, and Python rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "jdbc", "binaryFile")


def read(spark: SparkSession, kind: str, path: str | None = None, schema=None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path is not None else reader.load()


def stream(spark: SparkSession, kind: str, path: str | None = None, schema=None, **options) -> DataFrame:
    reader = spark.readStream.format(kind).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path is not None else reader.load()


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def scalars(spark: SparkSession, values: list, kind: str = "bigint") -> DataFrame:
    """A stream of plain values: the column ``this`` in the order ``__ord``."""
    return spark.createDataFrame(list(enumerate(values)), f"__ord bigint, this {kind}")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """Rows in the order ``__ord``."""
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"__ord bigint, {schema}")
