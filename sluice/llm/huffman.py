"""Token ids as canonical length-limited Huffman code in block files with bit-offset checkpoints.

A file holds the code lengths of all ids and then frames: a head, the documents' ids and sizes, the bit offset of every
block of BLOCK tokens, the bits. So a file is read without anything else, whole or one document of it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_chars, vocabulary
from .common import Scratch, open_store, partitions, release, small_batches, table
from .tokens import PATTERN, ChunkTable, Memory, check_rules

#: Width of the decoding table, if the ids fit.
MAX_BITS = 16
BLOCK = 1024
#: A frame of a file ends with the document that takes it over so many tokens.
FRAME = 1 << 21
#: Words that a worker remembers.
WORDS = 200_000
#: Texts are tokenized together up to so many bytes; a batch of more goes alone.
GROUP = 8 << 20
HEAD = struct.Struct("<4sIIQ")  # magic, documents, blocks, bytes of code
MAGIC = b"SLHF"
TABLE = struct.Struct("<4sII")  # magic, ids of the vocabulary, bytes of their code lengths
TABLE_MAGIC = b"SLHC"


# --- code ----------------------------------------------------------------------------------------


def width_for(n: int) -> int:
    """Bits that the longest code of n ids may have: 16, or two more than the ids need, 24 at most."""
    need = max(n - 1, 1).bit_length()
    if need > 24:
        raise ValueError(f"{n} distinct ids don't fit codes of 24 bits")
    return min(24, max(MAX_BITS, need + 2)) if need > MAX_BITS - 2 else MAX_BITS


def code_lengths(counts: np.ndarray, limit: int = 0) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (0: width_for) by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    limit = limit or width_for(n)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, weights = [], coins
    for _ in range(limit - 1):  # each level: coins and the pairs of the level below, by weight
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        weights = both[rank]
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for is_coin in reversed(levels):
        picked = int(is_coin[:take].sum())
        out[:picked] += 1
        take = 2 * (take - picked)
    out[:take] += 1
    lengths[order] = out
    return lengths


class Code:
    """A canonical code, whole in its lengths: codes rise by (length, id). ``bits`` is the width of the decoding table."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.bits = max(MAX_BITS, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        starts = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = starts >> (self.bits - lengths[order].astype(np.int64))
        self.order, self.width = order, width
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next ``bits`` bits: the id, and the length of its code."""
        if self._tables is None:
            symbol, size = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
            end = int(self.width.sum())
            symbol[:end], size[:end] = np.repeat(self.order, self.width), np.repeat(self.lengths[self.order], self.width)
            self._tables = symbol, size
        return self._tables

    def to_bytes(self) -> bytes:
        packed = zlib.compress(self.lengths.tobytes())
        return TABLE.pack(TABLE_MAGIC, len(self.lengths), len(packed)) + packed

    @classmethod
    def read(cls, f: pa.NativeFile) -> Code:
        """The code at a file's head."""
        magic, n, size = TABLE.unpack(f.read(TABLE.size))
        if magic != TABLE_MAGIC:
            raise ValueError("not a token file")
        return cls(np.frombuffer(zlib.decompress(f.read(size)), np.uint8, n))


def pack(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset at which each block of BLOCK ids starts."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    bits = code.lengths[ids].astype(np.int64)
    end = np.cumsum(bits)
    start = end - bits
    word = start >> 5
    value = code.codes[ids].astype(np.uint64) << (64 - (start & 31) - bits).astype(np.uint64)
    n = int(end[-1] + 31 >> 5) + 1
    # Codes never share a bit, so sums are unions; a sum stays below 2**32 and so exact.
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    out[1:] += np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:-1]
    return out.astype(">u4").tobytes(), start[::BLOCK].astype(np.uint64)


def unpack(data: bytes, offsets: np.ndarray, n: int, code: Code) -> np.ndarray:
    """n ids of the blocks that start at the bit offsets. All blocks are read side by side, one id of each per round."""
    if not n:
        return np.zeros(0, np.uint32)
    symbol, size = code.tables()
    buf = np.frombuffer(data + b"\0" * (BLOCK * code.bits // 8 + 8), np.uint8).astype(np.uint32)
    window = buf[:-3] << np.uint32(24) | buf[1:-2] << np.uint32(16) | buf[2:-1] << np.uint32(8) | buf[3:]
    at, out = offsets.astype(np.int64), np.empty((len(offsets), BLOCK), np.uint32)
    last, spare = len(window) - 1, np.uint32(32 - code.bits)
    for k in range(min(BLOCK, n)):
        place = np.minimum(at >> 3, last)
        bits = (window[place] << (at & 7).astype(np.uint32)) >> spare
        out[:, k] = symbol[bits]
        at += size[bits]
    return out.ravel()[:n]


# --- tokenizing ----------------------------------------------------------------------------------

_made: dict[str, ChunkTable] = {}
STOPS = (".", ",")


def library_cache(path: str) -> ChunkTable:
    """Chunks encoded by the tokenizers library, each once.

    The library's model encodes a word; chunks with added tokens go through the whole tokenizer.
    """
    if path in _made:
        return _made[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    check_rules(path)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    written = {b: c for c, b in byte_chars().items()}
    space, find, model = written[32], regex.compile(PATTERN).findall, tok.model.tokenize
    words = Memory(WORDS)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]

    def word(w: str) -> bytes:
        got = words.old.get(w)
        if got is None:
            as_chars = w.replace(" ", space) if w.isascii() and w.isprintable() else "".join([written[b] for b in w.encode()])
            got = array("I", [t.id for t in model(as_chars)]).tobytes()
        words.young[w] = got
        return got

    def encode(chunks: list[str]) -> list[bytes]:
        together = "\n".join(chunks)
        if any(t in together for t in added):
            return [array("I", e.ids).tobytes() for e in tok.encode_batch(chunks, add_special_tokens=False)]
        words.size = len(words.young)
        words.turn(0)
        get, out = words.young.get, []
        for c in chunks:
            # A chunk of letters alone, with or without its space, is one word; a full stop or comma behind them is another.
            if c[1:].isalpha() and (c[0] == " " or c.isalpha()):
                out.append(get(c) or word(c))
            elif c[-1:] in STOPS and c[1:-1].isalpha() and (c[0] == " " or c[0].isalpha()):
                out.append((get(c[:-1]) or word(c[:-1])) + (get(c[-1]) or word(c[-1])))
            else:
                out.append(b"".join([get(w) or word(w) for w in find(c)]))
        return out

    _made[path] = ChunkTable(encode)
    return _made[path]


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids by byte planes, then zstd: for the table between tokenizing and coding."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


# --- operator ------------------------------------------------------------------------------------

IDS = "kind int, doc_id long, n long, ids binary"
FILES = "pid int, path string, tokens long"
ROWS = "path string, doc_id long, place long, start long, n_tokens long, ids_crc32 long"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, up to GROUP bytes: the more texts, the fewer distinct chunks for each."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > GROUP:
            some, held, size = pa.concat_batches(held), [], 0
            yield some
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, scratch: Scratch, path: str, end_id: int = 0) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Tokenize and write docs in ascending doc_id order (null first): the files' table, each file's path and first token."""
    spark = docs.sparkSession

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = library_cache(path), np.zeros(end_id + 1, np.int64)
        for some in _together(batches):
            ids, ends = cache.ids(some.column(1))
            for k in range(0, len(ids), FRAME):
                got = np.bincount(ids[k : k + FRAME], minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
            counts[end_id] += len(ends)
            parts = [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(parts)), pa.int32()), some.column(0), pa.array([len(x) for x in parts], pa.int64()), pa.array([_squeeze(x) for x in parts], pa.binary())], ["kind", "doc_id", "n", "ids"])
            del ids, ends, parts
            release()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used)), pa.int32()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.nulls(len(used), pa.binary())], ["kind", "doc_id", "n", "ids"])
        release()

    ids = scratch.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, IDS), "ids", "kind")
    totals = ids.where("kind = 1").groupBy("doc_id").agg(F.sum("n")).collect()  # one row per id of the vocabulary
    counts = np.zeros(max([end_id, *(r[0] for r in totals)]) + 1, np.int64)
    for i, n in totals:
        counts[i] = n
    lengths = code_lengths(counts)
    root = scratch.path("files")
    fs, where = open_store(root)
    fs.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, out, total, code = TaskContext.get().partitionId(), None, 0, Code(lengths)
        name = f"{root}/part-{pid:06d}-{uuid.uuid4().hex}"  # files of attempts that fail are in no table
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for b in batches:
            for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    fs, where = open_store(name)
                    out = fs.open_output_stream(where)
                    out.write(code.to_bytes())
                held.append((doc_id, _expand(blob)))
                size += len(held[-1][1])
                total += len(held[-1][1])
                if size >= FRAME:
                    _write_frame(out, held, code)
                    held, size = [], 0
        if out is not None:
            if held:
                _write_frame(out, held, code)
            out.close()
            yield pa.RecordBatch.from_pylist([{"pid": pid, "path": name, "tokens": total}], pa.schema([("pid", pa.int32()), ("path", pa.string()), ("tokens", pa.int64())]))
        release()

    rows = ids.where("kind = 0").select("doc_id", "ids").repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), F.xxhash64("ids")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    files = scratch.save(rows.mapInArrow(write, FILES), "manifest")
    starts, at = [], 0
    for r in sorted(files.collect()):  # one row per file
        starts.append((r.path, at))
        at += r.tokens
    scratch.drop("ids")
    return files, starts


def _write_frame(out: pa.NativeFile, held: list[tuple[int | None, np.ndarray]], code: Code) -> None:
    data, offsets = pack(np.concatenate([x for _, x in held]), code)
    out.write(HEAD.pack(MAGIC, len(held), len(offsets), len(data)))
    out.write(np.array([d or 0 for d, _ in held], "<i8").tobytes())
    out.write(np.array([d is not None for d, _ in held], np.uint8).tobytes())
    out.write(np.array([len(x) for _, x in held], "<u4").tobytes())
    out.write(offsets.astype("<u8").tobytes())
    out.write(data)


def _heads(f: pa.NativeFile, path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, int]]:
    """Frame by frame: the documents' ids and sizes, the blocks' offsets, the number of bytes of bits, which come next."""
    while head := f.read(HEAD.size):
        magic, n_docs, n_blocks, n_bytes = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError(f"{path}: no frame")
        ids, there = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), np.uint8)
        sizes = np.frombuffer(f.read(4 * n_docs), "<u4").astype(np.int64)
        yield [int(i) if t else None for i, t in zip(ids, there)], sizes, np.frombuffer(f.read(8 * n_blocks), "<u8"), n_bytes


def read_frames(path: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The documents of a file, frame by frame."""
    fs, where = open_store(path)
    with fs.open_input_stream(where) as f:
        code = Code.read(f)
        for ids, sizes, offsets, n_bytes in _heads(f, path):
            tokens = unpack(f.read(n_bytes), offsets, int(sizes.sum()), code)
            yield ids, np.split(tokens, np.cumsum(sizes)[:-1])


def read_document(path: str, place: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the document at a place of a file: of the bits, only those of its blocks are read."""
    fs, where = open_store(path)
    with fs.open_input_file(where) as f:
        code = Code.read(f)
        for ids, sizes, offsets, n_bytes in _heads(f, path):
            if place >= len(ids):
                place -= len(ids)
                f.seek(f.tell() + n_bytes)
                continue
            begin = int(sizes[:place].sum())
            end = begin + int(sizes[place])
            a, b = begin // BLOCK, -(-end // BLOCK)
            low = int(offsets[a]) // 8 if a < len(offsets) else 0
            high = int(offsets[b]) // 8 + 1 if b < len(offsets) else n_bytes
            f.seek(f.tell() + low)
            tokens = unpack(f.read(high - low), offsets[a:b] - np.uint64(8 * low), min(b * BLOCK, int(sizes.sum())) - a * BLOCK, code)
            return ids[place], tokens[begin - a * BLOCK : end - a * BLOCK]
    raise IndexError(f"{path}: no such document")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files (path): path, doc_id, place in the file, start in the file, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                place = start = 0
                for ids, docs in read_frames(path):
                    rows = []
                    for i, d in zip(ids, docs):
                        rows.append((path, i, place, start, len(d), zlib.crc32(d.astype("<u4").tobytes())))
                        place, start = place + 1, start + len(d)
                    out = pd.DataFrame(rows, columns=["path", "doc_id", "place", "start", "n_tokens", "ids_crc32"])
                    yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        release()

    n = files.count()
    return files.select("path").repartition(max(1, n), "path").mapInPandas(read, ROWS)


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, start, n_tokens, ids_crc32, as read back from the files.

    Null text is empty: only the end id. Null doc_ids stand first; rows with equal doc_id are each written. An empty
    table gives no file and no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    files, starts = write_tokens(docs, scratch, path or vocabulary())
    first = spark.createDataFrame(starts, "__path string, __first long")  # one row per file
    rows = read_tokens(files).join(F.broadcast(first), F.col("path") == F.col("__path"))
    return rows.select("doc_id", (F.col("start") + F.col("__first")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
