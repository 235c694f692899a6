"""Shared pieces of the training-data operators: scratch tables, hashing rules, byte kernels.

Nothing here depends on the data's size: scratch tables live in the folder that the cluster names in
``spark.checkpoint.dir``, and the byte kernels work on pieces of at most ``PIECE`` bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Settings under which scratch tables are written.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
TRIM = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of single-byte characters take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, lengthened until no column is called so (column names don't heed case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound Arrow batches: texts may be long, so a batch holds fewer rows than Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """At a task's end, give freed memory back to the system: the worker lives on beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/sluice-shared"
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


class Scratch:
    """Tables of one run, in a folder of its own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def save(self, df: DataFrame, part: str, *by: str) -> DataFrame:
        """Write df and read it again: the lineage ends here and survives lost executors.

        What is written isn't shuffled again, so Spark may delete its shuffle files as soon as the table is there; and
        what goes to Python workers meanwhile goes in small batches.
        """
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            conf.set(k, v)
        try:
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(self.path(part))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.load(part, df)

    def load(self, part: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(part))

    def drop(self, part: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(part))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI in the shared folder, for tasks that write or read raw bytes."""
    return pafs.FileSystem.from_uri(uri)


def ordered_index(df: DataFrame, scratch: Scratch, part: str, *order: Column) -> DataFrame:
    """Add ``idx``, the 0-based rank in ``order``, without gathering the rows in one task.

    Range partitions are numbered inside themselves; only one count per partition goes to the driver.
    """
    spark = scratch.spark
    placed = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.save(placed.withColumn("__mid", F.monotonically_increasing_id()), part)
    pid, at = F.shiftright("__mid", 33), F.col("__mid").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(pid.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "__p long, __start long")
    return placed.join(F.broadcast(starts), pid == F.col("__p")).withColumn("idx", F.col("__start") + at).drop("__mid", "__p", "__start")


# --- bytes ---------------------------------------------------------------------------------------

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(2 * PIECE + 2, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    edge = np.empty(len(buf) + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_SPACE, buf, out=edge[1:-1])
    change = np.flatnonzero(edge[1:] != edge[:-1])
    return change[::2], change[1::2]


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over the bytes from prefix sums modulo 2**64, then mixed."""
    up, down = _powers()
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _SPREAD)


def _long_word(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the offset of each text's first word (one more at the end).

    Words of over PIECE bytes are hashed by blake2b, so that a buffer never exceeds 2 * PIECE bytes.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            parts = _long_text(texts[at])
            found.append(parts)
            counts[at + 1] = len(parts)
            at += 1
            continue
        first, size = at, 0
        while at < len(texts) and size + len(texts[at]) < PIECE:
            size += len(texts[at]) + 1
            at += 1
        at = max(at, first + 1)
        buf = np.frombuffer(b"\n".join(texts[first:at]), np.uint8)
        if not len(buf):
            continue
        starts, ends = spans(buf)
        found.append(_hash_spans(buf, starts, ends))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[first:at]])
        counts[first + 1 : at + 1] = np.diff(np.searchsorted(starts, begins))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)


def _long_text(text: bytes) -> np.ndarray:
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # one word of PIECE bytes at least
                nexts = [x for x in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(nexts, default=n)
                word = text[at:end]
                if len(word) > PIECE:
                    out.append(np.array([_long_word(word)], np.uint64))
                    at = end
                    continue
            else:
                end = cut + 1
        buf = np.frombuffer(text[at:end], np.uint8)
        out.append(_hash_spans(buf, *spans(buf)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, limit: int) -> DataFrame:
    """Inner join of rows with keyed, which has each key once and its number of rows in ``count``.

    Keys of over ``limit`` rows are broadcast, so their rows stay where they are; there are at most rows / limit of
    them. The rest is joined by a shuffle, in which no key has more than ``limit`` rows.
    """
    hot = F.broadcast(keyed.where(F.col(count) > limit))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col(count) <= limit), on)
    return rows.join(hot, on).unionByName(rest)


def components(edges: DataFrame, scratch: Scratch, part: str) -> DataFrame:
    """(node, label): the smallest node that each node of edges (u, v) is connected with.

    Labels fall by hooking parents to the smallest neighbouring label and by pointer jumping, in a number of rounds
    that grows with the logarithm of the longest path. Each round is written, so lineage stays short.
    """
    both = scratch.save(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{part}-edges")
    f = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), f"{part}-0")
    total, k = None, 0
    while True:
        now = f.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return f
        total, k = now, k + 1
        near = both.join(f, both["v"] == f["node"]).groupBy("u").agg(F.min("label").alias("low"))
        hooked = f.join(near, f["node"] == near["u"]).select("node", "label", "low")
        least = hooked.select("node", F.least("label", "low").alias("label")).unionByName(hooked.select(F.col("label").alias("node"), F.col("low").alias("label")))
        g = least.groupBy("node").agg(F.min("label").alias("label"))
        h = g.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        f = scratch.save(g.join(h, F.col("label") == F.col("n2"), "left").select("node", F.least("label", "l2").alias("label")), f"{part}-{k}")
        if k > 1:
            scratch.drop(f"{part}-{k - 2}")
