"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, small_batches, table

#: Units per direction, bytes per segment, segments side by side.
UNITS, STEPS, LANES = 8, 64, 4096
#: Documents per language in the training sample, and characters of a passage of each; documents of all languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 1500, 256, 30_000
#: More languages than this are refused: the sample would hold too few documents of each.
MAX_LANGS = 1000
ROUNDS, BATCH, RATE = 300, 96, 0.02
NO_LANGUAGE = "und"
#: What the pipeline's stage asks of a document: its best label's probability, averaged over all bytes.
MIN_SCORE = 0.5
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    """Weights, float32: of the bytes (3H, 256), of the state (3H, H) and its bias, per direction; of the labels.

    The rows of the first three stand for update gate, reset gate and candidate.
    """

    langs: list[str]
    p: dict[str, np.ndarray]


def new_net(langs: list[str], seed: int) -> Net:
    rng, h, k = np.random.default_rng(seed), UNITS, len(langs)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (3 * h, 256))
        p["x" + d][:h] += 1.0  # a high update gate keeps the state
        p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h))
        p["c" + d] = np.zeros((3 * h, 1))
    p["o"], p["b"] = rng.normal(0, 1 / np.sqrt(2 * h), (k, 2 * h)), np.zeros((k, 1))
    return Net(langs, {n: a.astype(np.float32) for n, a in p.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(net: Net, d: str, data: np.ndarray) -> list[tuple]:
    """What backpropagation needs of each step, in the order of the direction. data: bytes (steps, lanes)."""
    h, p = UNITS, net.p
    state = np.zeros((h, data.shape[1]), np.float32)
    kept = []
    for t in range(len(data)) if d == "f" else reversed(range(len(data))):
        x, g = p["x" + d][:, data[t]], p["u" + d] @ state + p["c" + d]
        z, r = _sigmoid(x[:h] + g[:h]), _sigmoid(x[h : 2 * h] + g[h : 2 * h])
        n = np.tanh(x[2 * h :] + r * g[2 * h :])
        new = (1 - z) * n + z * state
        kept.append((t, state, z, r, n, g[2 * h :], new))
        state = new
    return kept


def gradients(net: Net, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the labels of all positions, and its gradients by backpropagation through time."""
    h, p, (steps, lanes) = UNITS, net.p, data.shape
    runs = {d: _run(net, d, data) for d in "fb"}
    states = {d: dict((k[0], k[-1]) for k in runs[d]) for d in "fb"}
    both = np.stack([np.concatenate([states["f"][t], states["b"][t]]) for t in range(steps)])
    logits = p["o"] @ both + p["b"]
    logits -= logits.max(1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(1, keepdims=True)
    loss = -float(np.log(prob[:, label, np.arange(lanes)] + 1e-12).mean())
    delta = prob
    delta[:, label, np.arange(lanes)] -= 1
    delta /= steps * lanes
    grad = {"o": np.einsum("tkn,thn->kh", delta, both, optimize=True), "b": delta.sum((0, 2))[:, None]}
    back = np.einsum("kh,tkn->thn", p["o"], delta, optimize=True)
    for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        gx, gu, gc = np.zeros_like(p["x" + d]), np.zeros_like(p["u" + d]), np.zeros_like(p["c" + d])
        later = np.zeros((h, lanes), np.float32)
        for t, before, z, r, n, inner, _ in reversed(runs[d]):
            dh = back[t, part] + later
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dx, dg = np.concatenate([dz, dr, dn]), np.concatenate([dz, dr, dn * r])
            np.add.at(gx.T, data[t], dx.T)
            gu += dg @ before.T
            gc += dg.sum(1, keepdims=True)
            later = dh * z + p["u" + d].T @ dg
        grad["x" + d], grad["u" + d], grad["c" + d] = gx, gu, gc
    return loss, grad


def train(samples: list[tuple[bytes, str]], seed: int = 5, rounds: int = ROUNDS) -> Net:
    """Adam over random windows of the samples, languages in equal shares: rounds take them in turn, and there are as many
    more rounds as a batch can't hold all languages."""
    langs = sorted({lang for _, lang in samples})
    net, rng = new_net(langs, seed), np.random.default_rng(seed)
    if len(langs) < 2:
        return net
    pools = [[np.frombuffer(t, np.uint8) for t, lang in samples if lang == x] for x in langs]
    m = {n: np.zeros_like(a) for n, a in net.p.items()}
    v = {n: np.zeros_like(a) for n, a in net.p.items()}
    rounds *= -(-len(langs) // BATCH)
    for i in range(1, rounds + 1):
        label = (np.arange(BATCH) + (i - 1) * BATCH) % len(langs)
        rows = []
        for k in label:
            t = pools[k][rng.integers(len(pools[k]))]
            at = rng.integers(max(1, len(t) - STEPS + 1))
            rows.append(np.resize(t[at : at + STEPS], STEPS))
        _, grad = gradients(net, np.stack(rows, 1), label)
        rate = RATE * min(1.0, 2 * (1 - i / (rounds + 1)))
        for n, g in grad.items():
            np.clip(g, -1, 1, out=g)
            m[n] += 0.1 * (g - m[n])
            v[n] += 0.01 * (g * g - v[n])
            net.p[n] -= (rate * (m[n] / (1 - 0.9**i)) / (np.sqrt(v[n] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Labels every position of many segments side by side.

    Signs and factors of the gates are folded into the weights, so that each gate is 1 / (1 + exp(.)).
    """

    def __init__(self, net: Net) -> None:
        h, p = UNITS, net.p
        fold = np.concatenate([np.full(2 * h, -1), np.full(h, -2)]).astype(np.float32)[:, None]
        self.x = {d: np.ascontiguousarray(fold * p["x" + d]) for d in "fb"}
        self.u = {d: np.ascontiguousarray(fold * p["u" + d]) for d in "fb"}
        self.c = {d: fold * p["c" + d] for d in "fb"}
        self.o, self.b = {"f": np.ascontiguousarray(p["o"][:, :h]), "b": np.ascontiguousarray(p["o"][:, h:])}, p["b"]

    def _states(self, d: str, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h, (steps, lanes) = UNITS, data.shape
        out = np.empty((steps, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        x, g = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
        least = sizes.min()
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(self.x[d], data[t], axis=1, out=x, mode="clip")
            np.matmul(self.u[d], state, out=g)
            g += self.c[d]
            gates = x[: 2 * h]
            gates += g[: 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            n = g[2 * h :]
            n *= gates[h:]
            n += x[2 * h :]
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            state = out[t]
            np.subtract(out[t - 1] if d == "f" and t else out[t + 1] if d == "b" and t + 1 < steps else 0, n, out=state)
            state *= gates[:h]
            state += n
            if d == "b" and t >= least:
                state *= t < sizes  # behind a segment's end nothing has been read yet
        return out

    def sums(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per segment, the labels' probabilities summed over its positions. data: bytes (steps, lanes)."""
        with np.errstate(over="ignore"):
            f, b = self._states("f", data, sizes), self._states("b", data, sizes)
            total = np.zeros((len(self.b), data.shape[1]), np.float32)
            least = sizes.min()
            for t in range(len(data)):
                e = self.o["f"] @ f[t]
                e += self.o["b"] @ b[t]
                e += self.b
                e -= e.max(0)
                np.exp(e, out=e)
                e /= e.sum(0) if t < least else np.where(t < sizes, e.sum(0), np.inf)
                total += e
        return total

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text, the mean over all its positions (texts, languages)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        per = -(-lengths // STEPS)
        ends = np.cumsum(per)
        n = int(ends[-1]) if len(ends) else 0
        out = np.zeros((len(self.b), n), np.float64)
        joined = np.zeros(n * STEPS, np.uint8)
        sizes = np.full(n, STEPS, np.int64)
        for t, e, k, size in zip(texts, ends, per, lengths):
            joined[(e - k) * STEPS : (e - k) * STEPS + size] = np.frombuffer(t, np.uint8)
            if k:
                sizes[e - 1] = size - (k - 1) * STEPS
        for at in range(0, n, LANES):
            upto = min(n, at + LANES)
            data = np.ascontiguousarray(joined[at * STEPS : upto * STEPS].reshape(-1, STEPS).T).astype(np.intp)
            out[:, at:upto] = self.sums(data, sizes[at:upto])
        sums = np.concatenate([np.zeros((len(self.b), 1)), np.cumsum(out, 1)], 1)
        return ((sums[:, ends] - sums[:, ends - per]) / np.maximum(lengths, 1)).T


def learn(docs: DataFrame, folds: int = 5, seed: int = 5) -> Net | None:
    """Train on documents whose crc32(doc_id as text) mod ``folds`` is not 0 and whose text and lang aren't null.

    The sample is bounded: SAMPLE_DOCS documents of each language in a seeded order, SAMPLE_ALL of all, of each a passage
    of SAMPLE_CHARS characters from a seeded place; equal rows count once. The order is of a hash, so a language's first
    rows are those below a threshold that follows from its number of rows (four times as many as needed): only these are
    shuffled, whatever share of all rows a language has. More than MAX_LANGS languages raise an error.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    hashed = usable.select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low"))
    known = counts.take(MAX_LANGS + 1)
    if len(known) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not known:
        return None
    most = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // len(known)))
    upto = lambda n: int(4 * most / n * 2**64 - 2**63) if 4 * most < n else 2**63 - 1
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, max(r.low, upto(r.n))) for r in known], "lang string, upto long"))  # MAX_LANGS rows
    room = F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1))
    below = hashed.join(bounds, "lang").where(F.col("h") <= F.col("upto"))
    rows = below.select("lang", "h", F.col("text").substr((F.pmod("h", room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    rows = rows.groupBy("lang", "h").agg(F.min("t").alias("t"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most)
    samples = [(r.t.encode(), r.lang) for r in first.orderBy("lang", "k").collect() if r.t]
    return train(samples, seed) if samples else None


def identify(text: Column, net: Net | None) -> Column:
    """Struct of lang_pred and score. ``und`` with score 0 for null, without letters, or if nothing was learned."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(net) if net else None
        for batch in batches:
            has = [reader is not None and t is not None and _LETTER.search(t) is not None for t in batch]
            langs, scores = np.full(len(batch), NO_LANGUAGE, object), np.zeros(len(batch))
            if any(has):
                means = reader.pooled([t.encode() for t, x in zip(batch, has) if x])
                langs[has] = np.array(net.langs, object)[means.argmax(1)]
                scores[has] = np.clip(means.max(1), 0, 1)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        release()

    return run(text)


def languages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null text or text without letters: ``und``, score 0. A null doc_id is never learned from, and is not held out.
    Equal rows get equal predictions. Without rows to learn from all is ``und``. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    net = learn(docs)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", out.alias("held_out"), identify(F.col("text"), net).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def known_languages(docs: DataFrame, net: Net | None, min_score: float = MIN_SCORE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs whose predicted language is one of ``keep`` (None: any learned one) with a score of at least ``min_score``.

    Null text, text without letters, and all text if nothing was learned are ``und`` and go. Null and repeated ids and
    repeated rows are judged row by row; an empty table stays empty; columns may have any names, and all are returned.
    """
    name = "__p"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, identify(F.col("text"), net))
    p = F.col(name)
    good = (p["lang_pred"] != NO_LANGUAGE) & (p["score"] >= min_score)
    good = good & p["lang_pred"].isin(list(keep)) if keep is not None else good
    return marked.where(good).select(*[f"`{c}`" for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network places in a learned language; see ``known_languages``."""
    small_batches(spark)
    return known_languages(docs, learn(docs))
