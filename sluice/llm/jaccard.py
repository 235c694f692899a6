"""Exact n-gram Jaccard join of documents, and the components of its links.

Sets are compared along one global order of their elements, rarest first, so that two sets of enough overlap share an
element of their prefixes. The order comes from exact document frequencies: blocks of documents send their elements
to owners by hash range, and get the frequencies of those that several sets hold. The lists of the index hold only
such elements. Answers follow set relations: every set is first compared with the centre that it meets most often, and
once more with one of another group; sets of one verified group skip each other, and only lists in which several
groups meet yield more pairs, in blocks of positions that earlier lists have not covered; these pass a filter by
positions and sizes, one by bitmaps, and then the comparison of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, join_counted, mix64, open_store, partitions, release, small_batches, table, word_hashes

WORDS = 5
KEY_BITS = 40
#: Counts of a block share a 64-bit number with the key.
COUNT_MASK = (1 << 64 - KEY_BITS) - 1
BITMAP = 2048
#: So many elements before a set's position in a list tell whether a pair has met in an earlier list.
BEFORE = 8
_LOW = np.uint64(0xFFFFFFFFFFFFFFFF >> 4)
#: A block ends with the document that takes it to so many elements, or rows.
BLOCK_ELEMENTS, BLOCK_ROWS = 1_500_000, 1 << 19
BLOBS = "part int, block long, keys binary, counts binary"
FOUND = "kind int, block long, sid long, doc_id long, n int, s1 long, s2 long, h long, pos int, body binary, bits binary"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Per text, the sorted 60-bit hashes of its distinct shingles; of fewer words, that of the whole sequence."""
    hashes, offsets = word_hashes([t.lower() for t in texts])
    n, out = len(hashes), []
    rolled = np.zeros(0, np.uint64)
    if n >= words:
        rolled = hashes[: n - words + 1].copy()
        for k in range(1, words):
            rolled = mix64(rolled + hashes[k : n - words + 1 + k] * np.uint64(2 * k + 1))
        rolled = rolled & _LOW
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                x = mix64(x * np.uint64(3) + h)
            out.append(x & _LOW)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    x = mix64(values + np.uint64(0x51ED270B7F4A7C15))
    return int(x.sum(dtype=np.uint64).astype(np.int64)), int(mix64(x ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64))


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection with 100 * it >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Elements of which one at least is shared with any set that links: a partner shares percent / 100 of the set."""
    return n - -(-percent * n // 100) + 1


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as deltas by byte planes, then zstd."""
    deltas = np.diff(keys, prepend=keys[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(deltas).tobytes())


def expand_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Block:
    """Some of the documents that one task reads: their distinct sets, and the running fingerprint of all."""

    def __init__(self, number: int) -> None:
        self.number, self.names, self.rows, self.elements, self.mark = number, set(), 0, 0, 0

    @property
    def full(self) -> bool:
        return self.elements >= BLOCK_ELEMENTS or self.rows >= BLOCK_ROWS

    def take(self, doc_id: int | None, values: np.ndarray) -> tuple[int | None, int, np.ndarray, tuple[int, int], bool]:
        """doc_id, sid, set, identity, and whether the set is new to the block; sid is the row's number anywhere."""
        name = identity(values)
        self.mark = (self.mark * 31 + name[0] + len(values)) % (1 << 61)
        new = len(values) > 0 and (*name, len(values)) not in self.names
        if new:
            self.names.add((*name, len(values)))
        self.rows += 1
        self.elements += len(values)
        return doc_id, self.number << 20 | self.rows - 1, values, name, new


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list, bool]]:
    """The task's documents block by block: the block, some of its documents, and whether they are the last of it."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 16
    block = Block(number)
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(1).to_pylist()]
        some = []
        for doc_id, values in zip(batch.column(0).to_pylist(), shingle_sets(texts)):
            some.append(block.take(doc_id, values))
            if block.full:
                yield block, some, True
                block, some = Block(block.number + 1), []
        yield block, some, False
    yield block, [], True


# --- frequencies ---------------------------------------------------------------------------------


def key_of(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(60 - KEY_BITS)


def send_keys(docs: DataFrame, parts: int) -> DataFrame:
    """Per block and owner the sorted keys of the elements of the block's distinct sets, and in how many they are.

    Owners hold ranges of keys. The row with part -1 has the block's fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(parts + 1, dtype=np.float64) * (2.0**KEY_BITS / parts)).astype(np.uint64)
        held: list[np.ndarray] = []
        for block, some, last in walk(batches):
            held += [key_of(values) for _, _, values, _, new in some if new]
            if not last:
                continue
            keys, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held, cuts = [], np.searchsorted(keys, edges)
            rows = [(p, block.number, squeeze_keys(keys[i:j]), squeeze(np.minimum(counts[i:j], COUNT_MASK).astype("<u4"))) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            rows.append((-1, block.number, f"{block.rows}:{block.mark}".encode(), b""))
            for at in range(0, len(rows), 64):
                cols = zip(*rows[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "keys", "counts"])
            rows = cols = keys = counts = None
        release()

    return docs.mapInArrow(run, BLOBS)


def levels_of(total: np.ndarray) -> np.ndarray:
    """Frequencies in a byte: as they are below 128, then six steps per doubling, so that the order from rare to frequent
    holds up to some 300 million sets."""
    scaled = 128 + np.floor(6 * np.log2(np.maximum(total, 128) / 128))
    return np.where(total < 128, total, np.minimum(scaled, 255)).astype(np.uint8)


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each block the keys that several sets hold, with their frequencies' levels.

    Keys and counts are sorted in place as one array of 64-bit integers; blocks are expanded one at a time.
    """
    every = np.concatenate([expand_keys(k) << np.uint64(64 - KEY_BITS) | expand(c, "<u4") for k, c in zip(group["keys"], group["counts"])])
    every.sort()
    counts = (every & np.uint64(COUNT_MASK)).astype(np.uint32)
    every >>= np.uint64(64 - KEY_BITS)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    total = np.add.reduceat(counts, first, dtype=np.int64)
    common = total > 1
    keys, level = every[first[common]], levels_of(total[common])
    del every, counts, first, total, common
    out = []
    for b, blob in zip(group["block"], group["keys"]):
        k = expand_keys(blob)
        at = np.searchsorted(keys, k)
        hit = np.minimum(at, max(len(keys) - 1, 0))
        mine = hit[keys[hit] == k] if len(keys) else hit[:0]
        if len(mine):
            out.append((int(group["part"].iloc[0]), b, squeeze_keys(keys[mine]), squeeze(level[mine])))
    del keys, level
    release()
    return pd.DataFrame(out, columns=["part", "block", "keys", "counts"])


def replies(root: str, block: int) -> tuple[np.ndarray, np.ndarray, str]:
    """The keys of a block that several sets hold, their frequencies, and the block's fingerprint."""
    fs, where = open_store(root)
    keys, levels, mark = [], [], ""
    folder = f"{where}/block={block}"
    from pyarrow.fs import FileSelector

    rows = []
    for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            t = pq.read_table(f.path, filesystem=fs, partitioning=None)
            rows += zip(*(t.column(c).to_pylist() for c in ("part", "keys", "counts")))
    for part, k, c in sorted(rows, key=lambda r: r[0]):
        if part < 0:
            mark = k.decode()
        else:
            keys.append(expand_keys(k))
            levels.append(expand(c, "u1"))
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), (np.concatenate(levels) if levels else np.zeros(0, np.uint8)), mark


# --- index ---------------------------------------------------------------------------------------


def bitmap(values: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(values & np.uint64(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


def index(docs: DataFrame, root: str, percent: int) -> DataFrame:
    """Rows of three kinds: 0 documents, 1 postings of prefix elements that several sets hold, 2 sets with postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, levels, mark = -1, None, None, ""
        for block, some, last in walk(batches):
            if block.number != known:
                known = block.number
                keys, levels, mark = replies(root, known)
            rows: list[tuple] = []
            for doc_id, sid, values, name, new in some:
                n = len(values)
                rows.append((0, block.number, sid, doc_id, n, *name, None, None, None, None))
                if not new or not len(keys):
                    continue
                k = key_of(values)
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                level = np.where(keys[at] == k, levels[at], 1)
                ranked = np.lexsort((values, level))[: prefix(n, percent)]
                there = np.flatnonzero(level[ranked] > 1)
                if len(there):
                    h = values[ranked[there]].astype(np.int64).tolist()
                    rows += [(1, block.number, sid, None, n, None, None, x, p, None, None) for x, p in zip(h, there.tolist())]
                    rows.append((2, block.number, sid, None, n, None, None, None, None, values.tobytes(), bitmap(values)))
                if len(rows) >= 20_000:
                    yield _found(rows)
                    rows = []
            if rows:
                yield _found(rows)
            if last and mark != (f"{block.rows}:{block.mark}" if block.rows or mark else ""):
                raise ValueError("a task read other documents than before; write the table first")
        keys = levels = None
        release()

    return docs.mapInArrow(run, FOUND)


# --- pairs ---------------------------------------------------------------------------------------


def alike(pairs: DataFrame, sets: DataFrame, percent: int, by_bits: bool) -> DataFrame:
    """The pairs (u, v) whose whole sets link; or, by bitmaps, those that may: hashing bits only hides differences."""
    what = "bits" if by_bits else "body"
    a = sets.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col(what).alias("bu"))
    b = sets.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col(what).alias("bv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            need = -(-percent * (nu.astype(np.int64) + nv) // (100 + percent))
            bu, bv = batch.column("bu").to_pylist(), batch.column("bv").to_pylist()
            if by_bits:
                x = np.frombuffer(b"".join(bu), "<u8").reshape(-1, BITMAP // 64) ^ np.frombuffer(b"".join(bv), "<u8").reshape(-1, BITMAP // 64)
                keep = np.bitwise_count(x).sum(1, dtype=np.int64) <= nu.astype(np.int64) + nv - 2 * need
            else:
                keep = np.array([len(np.intersect1d(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), True)) >= k for p, q, k in zip(bu, bv, need)], bool)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    joined = pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "bu", "bv")
    return joined.mapInArrow(run, "u long, v long")


def centres(postings: DataFrame, percent: int) -> DataFrame:
    """Per list of several sets: h, its number of sets m, and ``cs``, one centre (sid, n, g) per band of sizes.

    A band spans sizes within percent of each other, so there are some tens at most. The centre is the set that has the
    fewest rarer elements before h: of a group of near copies, the one that differs least from what they share.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else F.col("n")
    best = postings.groupBy("h", band.alias("band")).agg(F.min(F.struct("pos", "sid", "n", "g")).alias("c"), F.count("*").alias("m"))
    return best.groupBy("h").agg(F.sum("m").alias("m"), F.collect_list(F.struct("c.sid", "c.n", "c.g")).alias("cs")).where("m > 1")


def meet(postings: DataFrame, lists: DataFrame, limit: int, ratio: Column) -> DataFrame:
    """(u, v, count): how often each set u meets a centre v of another group whose size may link, in the lists' order."""
    met = join_counted(postings.select("h", F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("g").alias("gu")), lists, ["h"], "m", limit)
    met = met.select("u", "nu", "gu", F.explode("cs").alias("c")).select("u", "nu", "gu", F.col("c.sid").alias("v"), F.col("c.n").alias("nv"), F.col("c.g").alias("gv"))
    return met.where((F.col("gu") != F.col("gv")) & ratio).groupBy("u", "v").count()


def favourite(met: DataFrame) -> DataFrame:
    return met.groupBy("u").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v"))


def several(placed: DataFrame) -> DataFrame:
    """Lists in which several groups meet: h, the list's largest group, and its number of sets."""
    sizes = placed.groupBy("h", "g").count()
    return sizes.groupBy("h").agg(F.max_by("g", F.struct("count", "g")).alias("top"), F.count("*").alias("k"), F.sum("count").alias("m")).where("k > 1").select("h", "top", "m")


def near_sets(postings: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (u, v) that connect just the sets which all links would connect.

    Twice, every set is compared with one centre of another group, and groups that link become one. Then the lists in
    which several groups still meet yield the pairs of sets of different groups, each in its first list only as far
    as the BEFORE elements before it in the sets' orders tell.
    """
    p = partitions(scratch.spark)
    ratio = F.lit(percent) * F.greatest("nu", "nv") <= F.least("nu", "nv") * 100
    limit = max(1, postings.count() // (4 * p))
    apart = postings.withColumn("g", F.col("sid"))
    first = scratch.save(favourite(meet(apart, scratch.save(centres(apart, percent), "lists"), limit, ratio)), "first")
    seeds = scratch.save(alike(first, sets, percent, False), "seeds")
    groups = components(seeds, scratch, "group")
    placed = postings.join(groups, postings["sid"] == groups["node"], "left").withColumn("g", F.coalesce("label", "sid")).select("h", "sid", "n", "pos", "g")
    placed = scratch.save(placed, "placed")
    # Lists of one group are skipped from here on.
    some = scratch.save(join_counted(placed, scratch.save(several(placed), "several"), ["h"], "m", limit).select("h", "sid", "n", "pos", "g"), "some")
    again = meet(some, scratch.save(centres(some, percent), "lists-2"), limit, ratio)
    tried = first.unionByName(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    second = scratch.save(favourite(again.join(tried, ["u", "v"], "left_anti")), "second")
    seeds2 = scratch.save(alike(second, sets, percent, False), "seeds-2")
    named = groups.select(F.col("node"), F.col("label"))
    ends = seeds2.join(named, F.col("u") == F.col("node"), "left").select(F.coalesce("label", "u").alias("u"), "v")
    ends = ends.join(named, F.col("v") == F.col("node"), "left").select("u", F.coalesce("label", "v").alias("v"))
    wider = components(ends, scratch, "wider")
    some = scratch.save(some.join(wider, some["g"] == wider["node"], "left").select("h", "sid", "n", "pos", F.coalesce("label", "g").alias("g")), "some-2")
    mixed = scratch.save(several(some), "mixed")
    last = W.partitionBy("sid").orderBy("pos").rowsBetween(-BEFORE, -1)
    some = join_counted(some, mixed, ["h"], "m", limit).withColumn("before", F.collect_list("h").over(last))
    some = scratch.save(some, "some-3")
    # Every set outside of the list's largest group meets the other groups.
    x = some.where("g <> top").select("h", F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("pos").alias("pu"), F.col("g").alias("gu"), F.col("before").alias("hu"))
    y = some.select("h", F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("pos").alias("pv"), F.col("g").alias("gv"), F.col("before").alias("hv"), "top")
    room = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent
    order = (F.col("u") < F.col("v")) | (F.col("gv") == F.col("top"))  # two sets outside of the largest group meet once
    pairs = x.join(y, "h").where((F.col("gu") != F.col("gv")) & order & ratio & room & ~F.arrays_overlap("hu", "hv"))
    pairs = scratch.save(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    close = scratch.save(alike(pairs, sets, percent, True), "close")
    return scratch.save(seeds.unionByName(seeds2).unionByName(alike(close, sets, percent, False)), "links")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Null text and text without words: an empty set, linked with nothing. Rows with equal sets link; a component's id is
    the smallest doc_id in it, null only if all are. Rows with equal doc_id count one by one. An empty table
    gives no rows. Other columns are not read, whatever their names. docs must read the same rows again (a table).
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, p = Scratch(spark, "jaccard"), partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    sent = scratch.save(send_keys(docs, p), "sent")
    got = sent.where("part >= 0").groupBy("part").applyInPandas(answer, BLOBS)
    marks = sent.where("part < 0")
    scratch.save(got.unionByName(marks), "replies", "block")
    found = scratch.save(index(docs, scratch.path("replies"), percent), "found", "kind")
    for part in ("sent", "replies"):
        scratch.drop(part)
    rows = found.where("kind = 0").select("sid", "doc_id", "n", "s1", "s2")
    limit = max(1, rows.count() // (4 * p))
    same = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("sid").alias("set"), F.count("*").alias("m")).where("m > 1")
    same = scratch.save(same, "same")
    named = scratch.save(join_counted(rows.where("n > 0"), same, ["s1", "s2", "n"], "m", limit).select("sid", "set"), "named")
    moved = named.where("sid <> set").withColumnRenamed("sid", "__sid")
    postings = found.where("kind = 1").select("h", "sid", "n", "pos").join(moved, F.col("sid") == F.col("__sid"), "left")
    postings = postings.select("h", F.coalesce("set", "sid").alias("sid"), "n", "pos").distinct()
    links = near_sets(scratch.save(postings, "postings"), found.where("kind = 2").select("sid", "n", "body", "bits"), scratch, percent)
    labels = components(links.unionByName(moved.select(F.col("__sid").alias("u"), F.col("set").alias("v"))), scratch, "all")
    placed = scratch.save(rows.join(labels, rows["sid"] == labels["node"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "label"), "rows")
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    linked = join_counted(placed.where("label is not null"), scratch.save(least, "least"), ["label"], "m", limit)
    alone = placed.where("label is null").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number by file and place in it. It is the same in every scan of a table, however it is split."""
    file, at, k = fresh([*docs.columns, name], "__file", "__at", "__k")
    place = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    files = sorted(r[0] for r in place.select(file).distinct().collect())
    known = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{k} long, {file} string")
    row = F.shiftleft(k, 40).bitwiseOR(F.col(at))
    return place.join(F.broadcast(known), file).select(*[f"`{c}`" for c in docs.columns], row.alias(name))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row, that of the smallest doc_id; null ids come last, rows of equal ids by their place.

    docs is a table of files. Null and empty texts are components of their own; columns may have any names.
    """
    (name,) = fresh(docs.columns, "__row")
    rows = numbered(docs, name)
    parts = jaccard_components(rows.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", name))
    stay = parts.join(rows.select(name, "doc_id"), name).groupBy("component_id").agg(best.alias("best")).select(F.col(f"best.{name}").alias(name))
    return rows.join(stay, name).select(*[f"`{c}`" for c in docs.columns])
