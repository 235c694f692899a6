"""Byte-level BPE encoding and decoding over contiguous arrays of parts and adjacent ranks."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table
from .tokens import PATTERN, ChunkCache, Memory, check_rules

NONE = np.int32(2**31 - 1)
#: Words of up to so many bytes go through the arrays side by side; longer ones one at a time.
SHORT = 32
#: Words, and characters of chunks, that a worker remembers; beyond, its memory starts anew.
KNOWN_WORDS, KNOWN_CHARS = 100_000, 2_500_000


def byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class ByteBPE:
    """The vocabulary of a tokenizer file, with encoding by repeated merging of the lowest rank.

    Per word, the parts and the ranks of adjacent parts stand in contiguous arrays. Each round takes the first
    minimum of the ranks, deletes the boundary behind it, and refreshes the ranks of the two neighbouring pairs.
    """

    def __init__(self, path: str) -> None:
        spec = check_rules(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in word) if word not in self.added else word.encode()
        for word, i in self.added.items():
            self.bytes[i] = word.encode()
        self.single = np.array([vocab[c] for c in sorted(chars, key=chars.get)], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self._place(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known = Memory(2 * KNOWN_WORDS)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> None:
        """An open-addressed table from pairs to ranks, at most a quarter full."""
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.rank_at = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.table[slot[todo]] < 0
            self.table[slot[todo[free]]] = keys[todo[free]]  # of several for one place the last wins
            won = self.table[slot[todo]] == keys[todo]
            self.rank_at[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts, or NONE; a part below 0 is none."""
        key = (left.astype(np.int64) << 32) | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        there = self.table[slot]
        out = np.where(there == key, self.rank_at[slot], NONE)
        todo = np.flatnonzero((there != key) & (there != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.table[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.rank_at[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32, for words of about the same length.

        Row j of the arrays holds part j of every word, so a round is a few passes over contiguous memory. A rank
        and its place share one integer: the minimum over the rows is the first of the lowest ranks.
        """
        n, width = len(words), max(map(len, words))
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T
        place = np.arange(width, dtype=np.int64)[:, None]
        parts = np.full((width + 1, n), -1, np.int32)
        parts[:-1] = np.where(place < sizes, self.single[raw], -1)
        rank = (self.ranks(parts[:-1].ravel(), parts[1:].ravel()).astype(np.int64) << 8).reshape(width, n) | place
        limit = np.int64(NONE) << 8
        done, live = np.full((width, n), -1, np.int32), np.arange(n)
        while True:
            best = rank.min(0)
            going = best < limit
            if not going.all():
                done[:, live[~going]] = parts[:-1, ~going]
                live = live[going]
                if not len(live):
                    break
                parts, rank, best = parts[:, going], rank[:, going], best[going]
            at, col = best & 255, np.arange(len(live))
            parts[at, col] = self.merged[best >> 8]
            behind = place > at
            np.copyto(parts[:-1], parts[1:], where=behind)
            np.copyto(rank[:-1], rank[1:] - 1, where=behind[:-1])
            rank[-1] = limit | (width - 1)
            before = np.maximum(at - 1, 0)
            fresh = self.ranks(np.concatenate([parts[at, col], parts[before, col]]), np.concatenate([parts[at + 1, col], parts[at, col]]))
            fresh = fresh.astype(np.int64) << 8
            rank[at, col] = fresh[: len(live)] | at
            rank[before, col] = np.where(at > 0, fresh[len(live) :] | before, rank[before, col])
        there = (done >= 0).T
        flat, ends = done.T[there].astype("<u4").tobytes(), np.cumsum(there.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """As merge_words for one long word: a heap over the ranks in place of the scan, as scanning is quadratic."""
        parts = self.single[np.frombuffer(word, np.uint8)].tolist()
        first = self.ranks(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32)).tolist()
        follow, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.ranks(np.array([parts[i]], np.int32), np.array([parts[j]], np.int32))[0])
            if r < NONE:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = follow[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            follow[i] = follow[j]
            if follow[i] >= 0:
                before[follow[i]] = i
                push(i, follow[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def _words(self, chunks: list[str]) -> list[list[str | int]]:
        """The words of each chunk; the strings of added tokens become their ids."""
        together = "\n".join(chunks)
        if not any(t in together for t in self.added):
            return list(map(self.words.findall, chunks))
        out: list[list[str | int]] = []
        for c in chunks:
            parts, at = [], 0
            for m in self.special.finditer(c):
                parts += [*self.words.findall(c[at : m.start()]), self.added[m[0]]]
                at = m.end()
            out.append(parts + self.words.findall(c[at:]))
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; words are merged once each."""
        cuts = self._words(chunks)
        self.known.size = len(self.known.young)
        self.known.turn(0)
        known = self.known.young
        again, fresh = self.known.split(set(chain.from_iterable(cuts)).difference(known))
        known.update(again)
        known.update((i, i.to_bytes(4, "little")) for i in fresh if i.__class__ is int)
        fresh = [w for w in fresh if w.__class__ is str]
        raw = [w.encode() for w in fresh]
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_width.setdefault(-(-len(b) // 4) * 4 if len(b) <= SHORT else 0, []).append(k)
        for width, where in by_width.items():
            for s in range(0, len(where), 8192):
                some = where[s : s + 8192]
                ids = self.merge_words([raw[k] for k in some]) if width else [self.merge_long(raw[k]) for k in some]
                known.update(zip([fresh[k] for k in some], ids))
        get = known.__getitem__
        return [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in cuts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_made: dict[str, tuple[ByteBPE, ChunkCache]] = {}


def coder(path: str) -> tuple[ByteBPE, ChunkCache]:
    """The vocabulary and the chunks known so far, kept by the worker process."""
    if path not in _made:
        bpe = ByteBPE(path)
        _made[path] = bpe, ChunkCache(bpe.encode_chunks, KNOWN_CHARS)
    return _made[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4") for b in coder(path)[1].ids(texts)]


def decode(ids: list[int], path: str) -> str:
    return coder(path)[0].decode(ids).decode("utf-8", errors="replace")


def bpe_digests(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids_sha256, decoded_sha256 for a text column. Null counts as empty: no tokens."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, cache = coder(path)
        decimal = [str(i).encode() for i in range(len(bpe.bytes))].__getitem__
        for batch in batches:
            rows = []
            for raw in cache.ids(["" if t is None else t for t in batch]):
                ids = np.frombuffer(raw, "<u4").tolist()
                text = bpe.decode(ids).decode("utf-8", errors="replace").encode()
                rows.append((len(ids), hashlib.sha256(b",".join(map(decimal, ids))).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return run(text)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no tokens. Null and repeated ids and repeated rows give a row each. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", bpe_digests(F.col("text"), path or vocabulary()).alias("b"))
    return rows.select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row of digests per row of docs."""
    return bpe(docs)
