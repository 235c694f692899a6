"""WARC archives: records with revisits for equal payloads, read back by verified chains of boundaries."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, open_store, partitions, small_batches, table

MAGIC = b"WARC/1.1\r\n"
SPLIT = 8 << 20
HEADER = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names its digest and length only."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def roles(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """pages with __top: the page that the row's record revisits, or null."""
    text = F.coalesce(F.col("html"), F.lit(""))
    row = {"__r1": F.xxhash64(F.lit(1), "page_id", text), "__r2": F.xxhash64(F.lit(2), "page_id", text)}
    slim = pages.where(F.octet_length(text) >= min_bytes).select("page_id", F.sha2(text, 256).alias("d"), *[c.alias(n) for n, c in row.items()])
    slim = scratch.save(slim, "slim")
    groups = slim.groupBy("d").agg(F.min("page_id").alias("__top"), F.count("*").alias("n")).where("n > 1")
    limit = max(1, slim.count() // (4 * partitions(scratch.spark)))
    found = join_counted(slim, scratch.save(groups, "groups"), ["d"], "n", limit)
    again = found.where((F.col("page_id") > F.col("__top")) | (F.col("page_id").isNull() & F.col("__top").isNotNull()))
    again = scratch.save(again.select("__r1", "__r2", "__top").distinct(), "again")
    return pages.withColumns(row).join(again, ["__r1", "__r2"], "left").select("page_id", "url", F.encode(text, "UTF-8").alias("payload"), "__top")


def write_archives(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One archive per task that has rows; (path, size) of those of successful tasks."""
    root = scratch.path("archives")
    fs, where = open_store(root)
    fs.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size = f"{root}/{uuid.uuid4().hex}.warc", None, 0
        for b in batches:
            for page_id, url, payload, top in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs, where = open_store(name)
                    out = fs.open_output_stream(where)
                data = record(page_id, url, payload, top)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]})

    return scratch.save(rows.mapInArrow(write, "path string, size long"), "manifest")


class View:
    """Bytes of a file by offset, read in pieces of SPLIT bytes at least."""

    def __init__(self, path: str, size: int) -> None:
        fs, where = open_store(path)
        self.file, self.size, self.at, self.data = fs.open_input_file(where), size, 0, b""

    def get(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start < self.at or end > self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(min(max(end - start, SPLIT), self.size - start), start)
        return self.data[start - self.at : end - self.at]

    def header(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, start of the block and successor of the record at an offset; None if none can stand there."""
        width = HEADER
        while True:
            head = self.get(at, at + width)
            if not head.startswith(MAGIC):
                return None
            end = head.find(b"\r\n\r\n")
            if end >= 0:
                break
            if at + width >= self.size:
                return None
            width *= 2
        fields = dict(x.split(": ", 1) for x in head[len(MAGIC) : end].decode("utf-8", "replace").split("\r\n") if ": " in x)
        length = fields.get("Content-Length", "")
        if not length.isdecimal():
            return None
        start = at + end + 4
        after = start + int(length) + 4
        return (fields, start, after) if after <= self.size and self.get(after - 4, after) == b"\r\n\r\n" else None


def candidates(splits: DataFrame, width: int) -> DataFrame:
    """(path, at, leaves) for each place of a split (path, size, split) that looks like a record.

    leaves: where the chain of successors from there leaves the split. Places whose chain breaks off are left out.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, split in zip(b["path"], b["size"], b["split"]):
                view, first, end = View(path, size), split * width, min((split + 1) * width, size)
                data = view.file.read_at(min(end + len(MAGIC) - 1, size) - first, first)
                found, k = [], data.find(MAGIC)
                while k >= 0:
                    if got := view.header(first + k):
                        found.append((first + k, got[2]))
                    k = data.find(MAGIC, k + 1)
                leaves: dict[int, int] = {}
                for at, after in reversed(found):
                    out = after if after >= end else leaves.get(after)
                    if out is not None:
                        leaves[at] = out
                yield pd.DataFrame({"path": path, "at": list(leaves), "leaves": list(leaves.values())}).astype({"at": "int64", "leaves": "int64"})

    return splits.mapInPandas(scan, "path string, at long, leaves long")


def entries(files: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(path, at): of each split, the first record that the chain from the file's start reaches; found by pointer jumping."""
    most = files.agg(F.max("size")).first()[0] or 0
    splits = files.withColumn("split", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / width)))).select("path", "size", F.col("split").cast("long").alias("split"))
    jumps = scratch.save(candidates(splits.repartition(partitions(scratch.spark), "path", "split"), width), "jump0")
    reached = files.select("path", F.lit(0).cast("long").alias("at"))
    rounds = max(1, (-(-most // width)).bit_length())
    for k in range(rounds):
        reached = scratch.save(reached.unionByName(reached.join(jumps, ["path", "at"]).select("path", F.col("leaves").alias("at"))), f"reached{k}")
        if k + 1 < rounds:
            on = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("__next"))
            jumps = scratch.save(jumps.join(on, ["path", "leaves"]).select("path", "at", F.col("__next").alias("leaves")), f"jump{k + 1}")
    ends = files.join(reached, ["path"]).where(F.col("at") == F.col("size")).select("path").distinct().count()
    if ends != files.count():
        raise ValueError("an archive's chain of records doesn't reach its end")
    return files.join(reached.distinct(), ["path"]).where(F.col("at") < F.col("size")).select("path", "size", "at")


def read_archives(files: DataFrame, scratch: Scratch, width: int = SPLIT) -> DataFrame:
    """The records of the archives; digests of payloads are computed anew and held against the headers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, at in zip(b["path"], b["size"], b["at"]):
                view, rows, end = View(path, size), [], min((at // width + 1) * width, size)
                while at < end:
                    fields, start, after = view.header(at)
                    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response":
                        payload = view.get(start, after - 4)
                        n, refers = len(payload), None
                        if digest(payload) != said:
                            raise ValueError(f"{path}: the payload at {at} doesn't have its digest")
                    else:
                        n, refers = int(fields["X-Payload-Length"]), int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
                    rows.append((int(page) if page else None, n, said, kind, refers))
                    at = after
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = scratch.save(entries(files, scratch, width), "entries")
    return found.repartition(partitions(scratch.spark), "path", "at").mapInPandas(read, RECORDS)


def archive(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT) -> DataFrame:
    """Per row: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    Null html: an empty payload; null url: an empty one. Of equal payloads that of the smallest page_id is the response;
    rows that share both payload and smallest id are all responses. A null page_id counts as larger than any. An
    empty table gives no archive and no rows. Other columns are not read, whatever their names.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc")
    files = write_archives(roles(pages.select("page_id", "url", "html"), scratch, min_bytes), scratch)
    return read_archives(files, scratch, split_bytes)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))
