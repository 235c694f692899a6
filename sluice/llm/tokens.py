"""Splitting texts into chunks that tokenize alone as they do in the text, and remembering the chunks' ids."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern by which byte-level BPE of this vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text without these is cut at every space; they are a superset of the white space that patterns know.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: As a pattern of Arrow, for a text behind a line feed: what keeps it from being cut at every space.
_ODD_ARROW = r"  | \n|\n | \z|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def check_rules(path: str) -> dict:
    """The content of a tokenizer file. Raises if the file cuts or changes texts in another way than PATTERN does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cutter = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    model = spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if not plain or model["type"] != "BPE" or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer is supported")
    return spec


def cut(text: str) -> list[str]:
    """Cut before each space that stands between two characters which aren't white space.

    A byte-level pattern never matches across such a place: a space goes to what follows it, and runs of white space
    lie inside one chunk with the characters around them. The space itself is left out.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return _SAFE.split(text)
    return text.split(" ")


def cut_all(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text, as cut gives them, with a line feed before the first of a text."""
    if texts.nbytes >= 1 << 30:
        texts = texts.cast(pa.large_string())  # with the line feeds, offsets of 32 bits might not do
    marked = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
    odd = pc.match_substring_regex(marked, _ODD_ARROW).to_numpy(zero_copy_only=False)
    if not odd.any():
        return pc.split_pattern(marked, " ")
    plain = pc.split_pattern(marked.filter(pa.array(~odd)), " ")
    others = pa.array([cut(t) for t in marked.filter(pa.array(odd)).to_pylist()], plain.type)
    place = np.empty(len(odd), np.int64)
    place[np.argsort(odd, kind="stable")] = np.arange(len(odd))
    return pa.concat_arrays([plain, others]).take(pa.array(place))


class Memory:
    """A bounded mapping of two generations: what the older one holds and nobody asks for is forgotten first."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def split(self, keys: set) -> tuple[dict, list]:
        """Of keys that aren't young: those known, which become young again, and the others."""
        known = {k: self.old[k] for k in keys if k in self.old}
        return known, [k for k in keys if k not in known]

    def turn(self, size: int) -> None:
        """Before ``size`` more is put into the young: they become the old if they would exceed half of the limit."""
        if self.size + size > self.limit // 2:
            self.old, self.young, self.size = self.young, {}, 0
        self.size += size


class ChunkCache:
    """Ids of texts as bytes of little-endian integers, from those of their chunks.

    encode gets distinct chunks, the leading space included, and returns the ids of each as bytes. About ``limit``
    characters of chunks are remembered.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 9_000_000) -> None:
        self.encode, self.memory = encode, Memory(limit)

    def ids(self, texts: list[str]) -> list[bytes]:
        found, open_ones, missing = [], [], set()
        get = self.memory.young.get
        for k, t in enumerate(texts):
            chunks = cut(t)
            chunks[0] = "\n" + chunks[0]  # no other chunk begins with white space: this one has no space before it
            got = list(map(get, chunks))
            if None in got:
                open_ones.append((k, chunks))
                missing.update([c for c, g in zip(chunks, got) if g is None])
            found.append(got)
        if missing:
            new, asked = self.memory.split(missing)
            new.update(zip(asked, self.encode([c[1:] if c[0] == "\n" else " " + c for c in asked])))
            for k, chunks in open_ones:
                found[k] = [new[c] if g is None else g for c, g in zip(chunks, found[k])]
            self.memory.turn(sum(map(len, new)))
            self.memory.young.update(new)
        return list(map(b"".join, found))


class ChunkTable:
    """Ids of many texts at once, from those of their chunks; Arrow cuts, looks up and joins.

    A call meets each distinct chunk once. Chunks and their ids are remembered in two arrays, the last used first, up to
    about ``limit`` bytes. encode is that of ChunkCache.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 32 << 20) -> None:
        self.encode, self.limit = encode, limit
        self.chunks, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids end. Null is empty."""
        lists = cut_all(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        ends, codes, chunks = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py(), coded.indices, coded.dictionary.cast(pa.large_string())
        del lists, coded
        place = pc.index_in(chunks, self.chunks)
        new = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy().copy()
        asked = chunks.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
        got = self.encode([c[1:] if c[0] == "\n" else " " + c for c in asked]) if asked else []
        rest = np.ones(len(self.chunks), bool)
        rest[place[~new]] = False
        place[new] = len(self.chunks) + np.arange(len(asked))
        values = pa.concat_arrays([self.values, pa.array(got, pa.large_binary())]).take(pa.array(place))
        del asked, got
        self._remember(chunks, values, rest)
        joined = values.take(codes)
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64, len(joined) + 1)[ends] // 4
        return np.frombuffer(data, "<u4", int(ends[-1])) if ends[-1] else np.zeros(0, "<u4"), ends

    def _remember(self, chunks: pa.Array, values: pa.Array, rest: np.ndarray) -> None:
        """Put chunks before those of the rest, and forget what the limit leaves no room for."""
        room = np.concatenate([_sizes(chunks, values), _sizes(self.chunks, self.values)[rest]]).cumsum() <= self.limit
        first, rest[rest] = pa.array(room[: len(chunks)]), room[len(chunks) :]
        rest = pa.array(rest)
        self.chunks = pa.concat_arrays([chunks.filter(first), self.chunks.filter(rest)])
        self.values = pa.concat_arrays([values.filter(first), self.values.filter(rest)])


def _sizes(chunks: pa.Array, values: pa.Array) -> np.ndarray:
    """Bytes that each chunk takes with its ids and both offsets."""
    return pc.binary_length(chunks).to_numpy() + pc.binary_length(values).to_numpy() + 16
