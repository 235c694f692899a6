"""Katz backoff language model of any order, with Good-Turing discounts and exactly normalised weights.

Documents are tokenized once, into a table of blocks, some blocks to a group. The counts live in owners' tables; level by
level, a group sends each owner the n-grams that its blocks hold, each once per block with its count, and gets back their
global counts and, per context, what its backoff weight is made of; replies are shuffled to their group, one file each,
and leave out the contexts whose training occurrences are all in the block, as it knows these itself. Blocks then know
the counts of their n-grams, send those that are one word longer, and at last evaluate all levels. So no task works on
more than one block or one owner's part at once, a frequent n-gram arrives once per block, and the number of owners
follows the number of tokens. Words are dealt by their hash. An owner numbers its n-grams, and what follows an n-gram is
counted where the n-gram is, by its number, so that sorted numbers travel as small differences. Contexts of over half an
owner's share are dealt by n-gram instead; their parts of the weight are summed after, at most two per owner.

All that travels is whole numbers: of a context the numbers of its continuations seen r times, for r up to CUT, and the
sum of larger counts; and both once more for the counts that the same continuations have one level below, from which
follows the probability that the lower level gives to all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, open_store, partitions, release, table, word_hashes

#: Words of the longest n-gram.
ORDER = 3
#: Counts of up to CUT are discounted.
CUT = 5
#: Tokens of a block; a longer document is a block by itself. Training tokens of an owner.
BLOCK_TOKENS, OWNER_TOKENS = 500_000, 750_000
#: Blocks of a group. A block is what a task works on; a group is what owners hear from and answer in one row.
GROUP = 4
#: Rows of a batch that are hashed together.
ROWS = 256
END, STEP = np.uint64(0x8B1F3D5A7C9E2461), np.uint64(0x9E3779B97F4A7C15)
#: Bits of a number among an owner's n-grams, or of a word's; what is above is the owner, or a context's place.
BITS = 40
#: The context before a text's first word: the last number of owner 0.
START = (1 << BITS) - 1
BLOCKS = "kind int, grp long, block long, n long, a binary, b binary, c binary, d binary"
MESSAGES = "part int, grp long, sizes binary, a binary, b binary, c binary, d binary, e binary, f binary"
REPLIES = "kind int, part int, grp long, a binary, b binary, c binary"
REPLY = ["kind", "part", "grp", "a", "b", "c"]
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Numbers of a context: its counts and those one level below.
STATS = 2 * (CUT + 1)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in as many bytes as the largest needs, by byte planes, then zstd."""
    top = int(x.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    planes = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(len(x), size).T)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{size}").ravel()


def _deltas(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x[:1] * 0))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _first(x: np.ndarray) -> np.ndarray:
    """Places at which runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d[r] for r up to CUT, 1 beyond (at CUT + 1). Where Good-Turing gives no falling discount, (r - 1/2) / r."""
    n = [counts_of_counts.get(r, 0) for r in range(CUT + 2)]
    out = np.ones(CUT + 2)
    spare = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare < 1 else 0.0
        out[r] = good if 0 < good < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """Discounted word probabilities; what is left goes to all unseen words together, as one more word."""

    n: int = 0
    v: int = 0
    d: np.ndarray = field(default_factory=lambda: np.ones(CUT + 2))
    unseen: float = 1.0

    @classmethod
    def of(cls, small: dict[int, int], n: int, v: int) -> Unigrams:
        d = discounts(small)
        if v and all(small.get(r, 0) == 0 for r in range(1, CUT + 1)):  # nothing to discount: half of each count of any size
            return cls(n, v, np.concatenate([np.ones(CUT + 1), [1 - 0.5 * v / n]]), 0.5 * v / n)
        lost = sum(r * k * (1 - d[r]) for r, k in small.items() if 1 <= r <= CUT)
        return cls(n, v, d, lost / n if n else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, CUT + 1)] * c / max(self.n, 1), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


@dataclass
class Deal:
    """How a run deals its counts: owners, training documents, tokens of a hot context."""

    parts: int
    starts: int
    limit: int


def owner(h: np.ndarray, parts: int) -> np.ndarray:
    """Owners hold ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, (_, k) in zip(zip(*rows[at : at + 64]), fields)], [n for n, _ in fields])


def _slices(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    cuts = np.searchsorted(part, np.arange(parts + 1))
    held = np.flatnonzero(cuts[1:] > cuts[:-1])
    return list(zip(held.tolist(), cuts[held].tolist(), cuts[held + 1].tolist()))


# --- blocks --------------------------------------------------------------------------------------


def tokenize(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, held_out, train, text). Kind 0: ids, flags, sizes, tokens as places among the block's
    sorted words. Kind 1: the words, and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, k, size = TaskContext.get().partitionId(), 0, 0
        parts: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, k
            ids = [i for p in parts for i in p[0]]
            flags, tokens, sizes = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
            parts = []
            words, place = np.unique(tokens, return_inverse=True)
            n = len(tokens)
            del tokens
            train = np.repeat((flags & 4) > 0, sizes)
            counts = np.bincount(place[train], minlength=len(words))
            group, block = pid << 32 | k // GROUP, k
            size, k = 0, k + 1
            yield from _batches([(0, group, block, n, np.array([i or 0 for i in ids], "<i8").tobytes(), flags.tobytes(), _pack(sizes), _pack(place))], BLOCKS)
            yield from _batches([(1, group, block, 0, _deltas(words), _pack(counts), b"", b"")], BLOCKS)

        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                ids, held, train, texts = (c.to_pylist() for c in batch.columns)
                hashes, offsets = word_hashes([b"" if t is None else t.lower() for t in texts])
                flags = np.array([(i is None) + 2 * h + 4 * t for i, h, t in zip(ids, held, train)], np.uint8)
                tokens = np.insert(hashes, offsets[1:], END)
                offsets = offsets + np.arange(len(offsets))
                at, sizes = 0, np.diff(offsets)
                while at < len(ids):
                    upto = at
                    while upto < len(ids) and (not size or size + sizes[upto] <= BLOCK_TOKENS):
                        size += int(sizes[upto])
                        upto += 1
                    if upto > at:
                        parts.append((ids[at:upto], flags[at:upto], tokens[offsets[at] : offsets[upto]], sizes[at:upto]))
                        at = upto
                    if at < len(ids):
                        yield from made()
        if parts:
            yield from made()
        release()

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """A row of kind 0 of the table of blocks. flags: 1 no id, 2 held out, 4 training."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["a"], "<i8")
        self.flags = np.frombuffer(row["b"], np.uint8)
        self.sizes = _unpack(row["c"]).astype(np.int64)
        self.tokens = _unpack(row["d"]).astype(np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat((self.flags & 4) > 0, self.sizes)


def stored(root: str, group: int) -> list[dict]:
    """The rows of a group in a table with a folder per group."""
    from pyarrow.fs import FileSelector

    fs, where = open_store(root)
    out: list[dict] = []
    for f in fs.get_file_info(FileSelector(f"{where}/grp={group}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            out += pq.read_table(f.path, filesystem=fs, partitioning=None).to_pylist()
    return out


def groups(blocks: DataFrame, kind: int) -> DataFrame:
    """The groups' numbers, dealt to tasks; each task reads its groups' files itself."""
    spark = blocks.sparkSession
    some = blocks.where(F.col("kind") == kind).select("grp").distinct()
    return some.repartition(max(1, min(some.count(), 8 * partitions(spark))), "grp")


def in_group(root: str, group: int) -> list[dict]:
    return sorted(stored(root, group), key=lambda r: r["block"])


class Answers:
    """What the owners answered to a group; its blocks take their shares in turn."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = {r["part"]: r for r in sorted(rows, key=lambda r: r["part"])}
        self.open: dict[tuple[int, str], np.ndarray] = {}
        self.at: dict[tuple[int, str], int] = {}
        self.told: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, part: int, field: str, n: int, rows: int = 1) -> np.ndarray:
        """The next n numbers of a field, or columns of one that has several rows."""
        key = part, field
        if key not in self.open:
            x = _unpack(self.rows[part][field])
            self.open[key] = x.reshape(rows, -1) if rows > 1 else x
        at = self.at.get(key, 0)
        self.at[key] = at + n
        return self.open[key][..., at : at + n]

    def numbers(self, part: int, ids: np.ndarray) -> np.ndarray:
        """The numbers of contexts, by ascending id: of each context the first block that asks takes them, others remember."""
        known, stats = self.told.get(part, (np.zeros(0, np.int64), np.zeros((STATS, 0))))
        at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
        there = known[at] == ids if len(known) else np.zeros(len(ids), bool)
        out = np.empty((STATS, len(ids)))
        out[:, there] = stats[:, at[there]]
        new = ids[~there]
        if len(new):
            out[:, ~there] = self.take(part, "b", len(new), STATS)
            ids, stats = np.concatenate([known, new]), np.concatenate([stats, out[:, ~there]], 1)
            order = np.argsort(ids)
            self.told[part] = ids[order], stats[:, order]
        return out


def save_replies(messages: DataFrame, count, scratch: Scratch, part: str, last: bool) -> DataFrame:
    """Let the owners answer; then, but for the last level, place the answers, one file per group.

    Two steps, so that the messages' shuffle files are gone before the replies are shuffled.
    """
    raw = scratch.save(messages.groupBy("part").applyInPandas(count, REPLIES), f"{part}-raw", "kind")
    if not last:
        scratch.save(raw.where("kind = 0").select("grp", "part", "a", "b", "c").repartition(partitions(scratch.spark), "grp"), part, "grp")
        scratch.drop(f"{part}-raw/kind=0")
    return raw


# --- words ---------------------------------------------------------------------------------------


def send_words(blocks: DataFrame, root: str, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (g for b in batches for g in b.column(0).to_pylist()):
            held = [(_sums(r["a"]), _unpack(r["b"])) for r in in_group(root, group)]
            cuts = [np.searchsorted(owner(w, parts), np.arange(parts + 1)) for w, _ in held]
            for p in range(parts):
                some = [(w[c[p] : c[p + 1]], n[c[p] : c[p + 1]]) for (w, n), c in zip(held, cuts)]
                sizes = np.array([len(w) for w, _ in some])
                if sizes.any():
                    yield from _batches([(p, group, _pack(sizes), _deltas(np.concatenate([w for w, _ in some])), _pack(np.concatenate([n for _, n in some])), b"", b"", b"", b"")], MESSAGES)
        release()

    return groups(blocks, 1).mapInArrow(run, MESSAGES)


def _summary(total: np.ndarray, more: int) -> bytes:
    small = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[: CUT + 2]
    return np.concatenate([small, [total.sum(), (total > 0).sum(), more]]).astype("<i8").tobytes()


def count_words(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's counts. Kind 0 for each group of blocks, in its order: counts, numbers among the owner's words, the most
    frequent first, and words of each block. Kind 1: counts of counts, tokens, words in training, all words."""
    words = [_sums(x) for x in group["a"]]
    every, where = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(where, np.concatenate([_unpack(x) for x in group["b"]]), len(every)).astype(np.int64)
    number = np.empty(len(every), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(every))
    out, at, part = [], 0, int(group["part"].iloc[0])
    for name, sizes, w in zip(group["grp"], group["sizes"], words):
        mine = where[at : at + len(w)]
        out.append((0, part, name, _pack(total[mine]), _pack(number[mine]), sizes))
        at += len(w)
    out.append((1, part, -1, _summary(total, len(every)), b"", b""))
    return pd.DataFrame(out, columns=REPLY)


def totals(replies: DataFrame) -> tuple[dict[int, int], int, int]:
    """Over all owners: the counts of counts, tokens and distinct n-grams."""
    names = [f"s{i}" for i in range(CUT + 5)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(np.array([np.frombuffer(a, "<i8") for a in b["a"]]).reshape(-1, CUT + 5), columns=names)

    rows = replies.where("kind = 1").select("a").mapInPandas(read, ", ".join(f"{n} long" for n in names))
    t = [int(x or 0) for x in rows.agg(*[F.sum(n) for n in names]).first()]
    return {r: t[r] for r in range(1, CUT + 2)}, t[CUT + 2], t[CUT + 3]


# --- n-grams -------------------------------------------------------------------------------------


@dataclass
class Grams:
    """The block's distinct n-grams of a level.

    before: of each token, its context, the last one standing for a text's start. place: of each token, its n-gram.
    Of each n-gram: context, second (its last word), suffix (the n-gram of the level below), part (owner), count, id (of
    owner and number); order: n-grams by owner; seen (training count in the block). Of each context: contexts (its id),
    hot, whole (all its training occurrences are in the block), stats (its numbers).
    """

    before: np.ndarray
    place: np.ndarray
    context: np.ndarray
    second: np.ndarray
    suffix: np.ndarray
    contexts: np.ndarray
    hot: np.ndarray
    whole: np.ndarray
    part: np.ndarray
    order: np.ndarray
    seen: np.ndarray
    count: np.ndarray | None = None
    id: np.ndarray | None = None
    stats: np.ndarray | None = None


def words_of(b: Block, place: int, got: Answers, deal: Deal) -> tuple[Grams, np.ndarray]:
    """The words of the block at a place of its group as n-grams of one word, and their numbers among all words, low for
    frequent ones."""
    sizes = [(p, int(_unpack(r["c"])[place])) for p, r in got.rows.items()]
    count = np.concatenate([np.zeros(0, np.int64), *(got.take(p, "a", n) for p, n in sizes)]).astype(np.int64)
    mine = np.concatenate([np.zeros(0, np.int64), *(got.take(p, "b", n) for p, n in sizes)]).astype(np.int64)
    part = np.repeat(np.array([p for p, _ in sizes], np.int64), [n for _, n in sizes])
    none = np.zeros(0, np.int64)
    return Grams(none, b.tokens, none, none, none, none, none, none, part, none, none, count, part << BITS | mine), mine * deal.parts + part


def longer(b: Block, low: Grams, number: np.ndarray, deal: Deal) -> Grams:
    """The n-grams that are one word longer than those of ``low``, by their contexts' ids and last words' numbers."""
    n, v = len(low.id), len(number)
    before = np.empty(len(b.tokens), np.int64)
    before[1:] = low.place[:-1]
    before[b.heads] = n
    contexts = np.append(low.id, START)
    by_id, by_number = np.argsort(contexts), np.argsort(number)
    rank, word = np.empty(n + 1, np.int64), np.empty(v, np.int64)
    rank[by_id], word[by_number] = np.arange(n + 1), np.arange(v)
    keys, place = np.unique(rank[before] * v + word[b.tokens], return_inverse=True)
    del rank, word
    context = keys // v
    second = by_number[keys - context * v]
    context = by_id[context]
    del keys, by_id, by_number
    suffix = np.empty(len(context), np.int64)
    suffix[place] = low.place
    total = np.append(low.count, deal.starts)
    hot = total > deal.limit
    seen = np.bincount(place[b.train], minlength=len(context))
    whole = (np.bincount(context, seen, n + 1) == total) & ~hot
    part = (contexts >> BITS)[context]
    order = np.arange(len(part))
    many = hot[context]
    if many.any():
        both = contexts[context[many]].astype(np.uint64) * STEP + number[second[many]].astype(np.uint64)
        part[many] = owner(mix64(both), deal.parts)
        order = np.argsort(part, kind="stable")
    return Grams(before, place, context, second, suffix, contexts, hot, whole, part, order, seen)


def numbers(context: np.ndarray, n: int, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The numbers of n contexts whose n-grams are all here."""
    out = np.empty((STATS, n))
    for k, x in enumerate((count, np.where(count > 0, lower, 0))):
        for r in range(1, CUT + 1):
            out[k * (CUT + 1) + r - 1] = np.bincount(context[x == r], minlength=n)
        out[k * (CUT + 1) + CUT] = np.bincount(context, np.where(x > CUT, x, 0), n)
    return out


def answered(g: Grams, low: Grams, got: Answers, deal: Deal, hot: dict[int, np.ndarray] | None, last: bool, need_stats: bool) -> None:
    """Put what the owners answered into g; n-grams of the last level have no ids."""
    context, part = g.context[g.order], g.part[g.order]
    g.count = g.seen.copy()
    open_ones = ~g.whole[context]
    if not last:
        g.id = np.empty(len(context), np.int64)
    if need_stats:
        g.stats = numbers(g.context, len(g.contexts), g.seen, low.count[g.suffix])
    for p, i, j in _slices(part, deal.parts):
        more = open_ones[i:j]
        g.count[g.order[i:j][more]] = got.take(p, "a", int(more.sum()))
        if not last:
            g.id[g.order[i:j]] = p << BITS | np.cumsum(got.take(p, "c", j - i), dtype=np.uint64).astype(np.int64)
        if need_stats:
            some = context[i:j][more]
            some = some[_first(some)]
            g.stats[:, some] = got.numbers(p, g.contexts[some])
    if need_stats and hot:
        for c in np.unique(g.context[g.hot[g.context]]).tolist():
            g.stats[:, c] = hot[int(g.contexts[c])]


def climb(b: Block, place: int, replies: list[Answers], deal: Deal, order: int, hots: list[dict] | None = None) -> tuple[list[Grams], np.ndarray]:
    """The levels that have been counted: words, pairs, and so on; with ``hots``, the contexts' numbers too."""
    grams, number = words_of(b, place, replies[0], deal)
    levels = [grams]
    for k, got in enumerate(replies[1:]):
        low = levels[-1]
        levels.append(longer(b, low, number, deal))
        answered(levels[-1], low, got, deal, hots[k] if hots else None, k + 2 == order, hots is not None)
    return levels, number


def send_grams(blocks: DataFrame, root: str, roots: list[str], deal: Deal, order: int) -> DataFrame:
    """A group's n-grams by owner: runs and n-grams of each block; contexts' ids, their runs, words' numbers, training
    counts, the suffixes' global counts, and whether the context is dealt by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (g for b in batches for g in b.column(0).to_pylist()):
            replies, held = [Answers(stored(r, group)) for r in roots], []
            for place, row in enumerate(in_group(root, group)):
                b = Block(row)
                levels, number = climb(b, place, replies, deal, order)
                low = levels[-1]
                del levels
                g = longer(b, low, number, deal)
                context, part = g.context[g.order], g.part[g.order]
                heads = _first(part * len(g.contexts) + context)
                of = context[heads]
                small = lambda x: x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x
                runs = (g.contexts[of], small(np.diff(heads, append=len(context))), g.hot[of])
                grams = (small(number[g.second][g.order]), small(g.seen[g.order]), small(low.count[g.suffix][g.order]))
                edges = np.arange(deal.parts + 1)
                held.append((runs, np.searchsorted(part[heads], edges), grams, np.searchsorted(part, edges)))
                del g, low, b, context, part, heads, of
            for p in range(deal.parts):
                sizes = np.array([[cut[p + 1] - cut[p] for cut in (c, d)] for _, c, _, d in held]).T
                if not sizes.any():
                    continue
                ids, lengths, hot = (np.concatenate([r[k][c[p] : c[p + 1]] for r, c, _, _ in held]) for k in range(3))
                word, seen, lower = (np.concatenate([x[k][d[p] : d[p + 1]] for _, _, x, d in held]) for k in range(3))
                yield from _batches([(p, group, _pack(sizes.ravel()), _deltas(ids.astype(np.uint64)), _pack(lengths), _pack(word), _pack(seen), _pack(lower), _pack(hot))], MESSAGES)
            del held, replies
        release()

    return groups(blocks, 0).mapInArrow(run, MESSAGES)


def count_grams(last: bool):
    """An owner's n-grams. Kind 0 for each group, block by block: the counts of its n-grams and the numbers of their contexts,
    these once per group, and both without the contexts that are whole in the block; and but for the last level the numbers of all its n-grams among the
    owner's. Kind 1: counts of counts. Kind 2: ids and numbers of the contexts that are dealt by n-gram."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        every, which = np.unique(np.concatenate([_sums(x) for x in group["a"]]), return_inverse=True)
        runs = [_unpack(x).astype(np.int64) for x in group["b"]]
        key = np.repeat(which << BITS, np.concatenate(runs))
        key |= np.concatenate([_unpack(x) for x in group["c"]]).astype(np.int64)
        if len(every) >= 1 << 63 - BITS:
            raise ValueError("an owner holds too many contexts")
        order = np.argsort(key)
        key = key[order]
        first = _first(key)
        seen = np.concatenate([_unpack(x) for x in group["d"]]).astype(np.int64)
        total = np.add.reduceat(seen[order], first)
        lower = np.concatenate([_unpack(x) for x in group["e"]]).astype(np.int64)[order[first]]
        lower[total == 0] = 0
        of = _first(key[first] >> BITS)
        where = np.empty(len(order), np.int32)
        where[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
        del key, order, first
        stats = np.empty((STATS, len(every)), np.uint64)
        for k, x in enumerate((total, lower)):
            for r in range(1, CUT + 1):
                stats[k * (CUT + 1) + r - 1] = np.add.reduceat(x == r, of, dtype=np.int64)
            stats[k * (CUT + 1) + CUT] = np.add.reduceat(np.where(x > CUT, x, 0), of)
        if stats.max(initial=0) < 1 << 32:
            stats = stats.astype(np.uint32)
        dealt = np.concatenate([_unpack(x) for x in group["f"]]) > 0
        starts = np.cumsum(np.concatenate(runs)) - np.concatenate(runs)
        open_ones = dealt | (np.add.reduceat(seen, starts) != np.add.reduceat(total, of)[which])
        del seen
        out, at, head, part = [], 0, 0, int(group["part"].iloc[0])
        for name, sizes, r in zip(group["grp"], group["sizes"], runs):
            mine, more = where[at : at + int(r.sum())], open_ones[head : head + len(r)]
            ids = b""
            if not last:  # differences that begin anew with each block
                per_block = _unpack(sizes).astype(np.int64).reshape(2, -1)[1]
                ids = np.diff(mine, prepend=0).astype(np.int64)
                begins = (np.cumsum(per_block) - per_block)[per_block > 0]
                ids[begins] = mine[begins]
                ids = _pack(ids)
            asked = which[head : head + len(r)][more]
            asked = asked[np.sort(np.unique(asked, return_index=True)[1])]  # each context once per group
            out.append((0, part, name, _pack(total[mine[np.repeat(more, r)]]), _pack(stats[:, asked].ravel()), ids))
            at, head = at + len(mine), head + len(r)
        hot = np.unique(which[dealt])
        if len(hot):
            out.append((2, part, -1, _pack(every[hot]), _pack(stats[:, hot].ravel()), b""))
        out.append((1, part, -1, _summary(total, 0), b"", b""))
        del stats, where, which, every, total, lower
        release()
        return pd.DataFrame(out, columns=REPLY)

    return run


def hot_contexts(replies: DataFrame) -> dict[int, np.ndarray]:
    """The sums over the owners for the contexts that are dealt by n-gram: two per owner at most."""
    names = [f"s{i}" for i in range(STATS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, stats in zip(b["a"], b["b"]):
                h = _unpack(h).astype(np.int64)
                yield pd.DataFrame({"h": h} | dict(zip(names, _unpack(stats).reshape(STATS, len(h)).astype(np.int64))))

    rows = replies.where("kind = 2").select("a", "b").mapInPandas(run, ", ".join(["h long", *(f"{n} long" for n in names)]))
    found = rows.groupBy("h").agg(*[F.sum(n) for n in names]).collect()
    return {r[0]: np.array(r[1:], np.float64) for r in found}


# --- scores --------------------------------------------------------------------------------------


def backoff(stats: np.ndarray, d: np.ndarray, low_d: np.ndarray, low_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context, its backoff weight and the number that its discounted counts are divided by.

    The weight is the mass that discounting frees over the lower level's mass of the words not seen after the context, so
    that all probabilities sum to 1. A context that has no small count to discount counts one more, unseen token.
    """
    size = np.arange(1, CUT + 1)
    of = lambda s: size @ s[:CUT] + s[CUT]
    kept = lambda s, d: (d[1 : CUT + 1] * size) @ s[:CUT] + d[CUT + 1] * s[CUT]
    mine, below = stats[: CUT + 1], stats[CUT + 1 :]
    count = of(mine)
    whole = np.maximum(count + (mine[:CUT].sum(0) == 0), 1)
    return np.where(count > 0, (1 - kept(mine, d) / whole) / (1 - kept(below, low_d) / low_whole), 1.0), whole


def probabilities(levels: list[Grams], unigrams: Unigrams, ds: list[np.ndarray]) -> np.ndarray:
    """Of each n-gram of the last level, the probability of its last word after the others: level by level, seen n-grams
    by their discounted counts, others by the weight of their context times the probability of their suffix."""
    p, d, whole = unigrams.p(levels[0].count), unigrams.d, None
    for k, (g, d_k) in enumerate(zip(levels[1:], ds)):
        if whole is None:
            low_whole = np.full(len(g.contexts), max(unigrams.n, 1), np.float64)
        else:  # of the context without its first word
            shorter = np.zeros(len(g.contexts), np.int64)
            shorter[g.before] = levels[k].before
            low_whole = whole[shorter]
        alpha, whole = backoff(g.stats, d_k, d, low_whole)
        p = np.where(g.count > 0, d_k[np.minimum(g.count, CUT + 1)] * g.count / whole[g.context], alpha[g.context] * p[g.suffix])
        d = d_k
    return p


def score_blocks(replies: DataFrame, blocks_root: str, roots: list[str], unigrams: Unigrams, ds: list[np.ndarray], hots: list[dict], deal: Deal, order: int) -> DataFrame:
    """Scores by group, from the replies of the last level; what else a group needs lies in files of its own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name, out = int(group["grp"].iloc[0]), []
        answers = [*(Answers(stored(r, name)) for r in roots), Answers(group.to_dict("records"))]
        for place, row in enumerate(in_group(blocks_root, name)):
            b = Block(row)
            levels, _ = climb(b, place, answers, deal, order, hots)
            n = len(b.sizes)
            doc = np.repeat(np.arange(n), b.sizes)
            add = lambda x: np.bincount(doc, x, n)
            c = levels[0].count
            out.append(pd.DataFrame({
                "doc_id": pd.array(b.ids, "Int64"), "held_out": (b.flags & 2) > 0, "n_tokens": b.sizes, "n_known": add((c > 0).astype(float)[b.tokens]).astype(np.int64), "train_tokens": unigrams.n,
                "base_score": add(unigrams.base(c)[b.tokens]), "score": add(np.log10(probabilities(levels, unigrams, ds))[levels[-1].place]),
            }))
            out[-1].loc[(b.flags & 1) > 0, "doc_id"] = pd.NA
            del levels, b, doc
        del answers
        release()
        return pd.concat(out, ignore_index=True)

    return replies.where("kind = 0").select("grp", "part", "a", "b", "c").groupBy("grp").applyInPandas(run, OUT)


def lm_scores(docs: DataFrame, folds: int = 10, order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training takes the rows whose crc32(doc_id as text) mod ``folds`` is not 0. Contexts reach up to order - 1 words back, and
    before a text's first word stand as many marks of its start. Null text is empty: one token, the end. A null doc_id is
    neither learned from nor held out. Repeated rows count each time. Without training rows all words are unseen, with
    probability 1 as one class. An empty table gives no rows. Other columns are not read, whatever their names. One
    document's tokens must fit a task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), flag(rest == 0).alias("held_out"), flag(rest != 0).alias("train"), F.encode("text", "UTF-8").alias("text"))
    blocks = scratch.save(tokenize(rows), "blocks", "kind", "grp")
    starts = rows.where("train").count()
    parts = max(partitions(spark), -(-(blocks.where("kind = 0").agg(F.sum("n")).first()[0] or 0) // OWNER_TOKENS))
    replies = save_replies(send_words(blocks, scratch.path("blocks/kind=1"), parts), count_words, scratch, "level1", order == 1)
    scratch.drop("blocks/kind=1")
    small, n, v = totals(replies)
    unigrams = Unigrams.of(small, n, v)
    deal = Deal(parts, starts, max(1, n // (2 * parts)))
    blocks = scratch.load("blocks", blocks)
    root, roots, ds, hots = scratch.path("blocks/kind=0"), [], [], []
    for k in range(2, order + 1):
        roots.append(scratch.path(f"level{k - 1}"))
        replies = save_replies(send_grams(blocks, root, roots, deal, order), count_grams(k == order), scratch, f"level{k}", k == order)
        ds.append(discounts(totals(replies)[0]))
        hots.append(hot_contexts(replies))
    return score_blocks(replies, root, roots, unigrams, ds, hots, deal, order)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
