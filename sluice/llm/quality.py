"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TRIM, Scratch, mix64, small_batches, table, word_hashes

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: name: (votes good up to, votes bad from), or the reverse where good is the higher; between the two it abstains.
RULES = {
    "symbols_per_word": (0.02, 0.10),
    "marks_per_word": (0.05, 0.30),
    "upper_share": (0.15, 0.40),
    "dup_line_share": (0.0, 0.60),
    "repeat_share": (0.10, 0.50),
    "letter_share": (0.85, 0.70),
    "symbol_share": (0.01, 0.06),
    "chars_per_word_far": (3.0, 5.0),
    "words_per_sentence_far": (1.2, 2.2),
}
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"


def repeat_words(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words inside 3-word windows that the text holds at least twice."""
    n, sizes = len(hashes), np.diff(offsets)
    if n < 3:
        return np.zeros(len(sizes), np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = mix64(hashes[:-2] + mix64(hashes[1:-1] + mix64(hashes[2:] + doc[:-2] * np.uint64(0x9E3779B97F4A7C15))))
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    order = inside[np.argsort(key[inside])]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flag = np.zeros(n, bool)
    flag[order[twice]] = True
    cover = flag.copy()
    cover[1:] |= flag[:-1]
    cover[2:] |= flag[:-2]
    return np.diff(np.concatenate([[0], np.cumsum(cover)])[offsets])


def _measures(text: str, raw: bytes, n_words: int, repeats: int) -> tuple[list[int], list[float | None]]:
    chars = len(text) - sum(map(text.count, TRIM))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(TRIM)]
    dups = len(lines) - len(set(lines))
    if not n_words:
        return [0, chars, symbols, dups, 0], [None] * len(RULES)
    letters = len(raw) - len(raw.translate(None, LETTERS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    solid = len(raw) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    stops = text.count(".") + text.count("?") + text.count("!")
    values = [
        symbols / n_words, text.count("!") / n_words, upper / letters if letters else None, dups / len(lines) if len(lines) > 1 else None,
        repeats / n_words, letters / solid, symbols / chars, abs(chars / n_words - 5.5), abs(np.log10(n_words / max(stops, 0.5) / 10)),
    ]
    return [n_words, chars, symbols, dups, repeats], values


def vote(values: list[float | None]) -> int:
    """Votes as one number to the base 3, the first rule lowest: 0 abstains, 1 good, 2 bad."""
    pattern = 0
    for value, (good, bad) in zip(reversed(values), reversed(RULES.values())):
        sign = 1 if good <= bad else -1
        v = 0 if value is None else 1 if sign * value <= sign * good else 2 if sign * value >= sign * bad else 0
        pattern = pattern * 3 + v
    return pattern


def measured(text: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            raw = [t.encode() for t in texts]
            hashes, offsets = word_hashes(raw)
            repeats = repeat_words(hashes, offsets)
            rows = []
            for t, r, n, k in zip(texts, raw, np.diff(offsets).tolist(), repeats.tolist()):
                counts, values = _measures(t, r, n, k)
                rows.append((*counts, vote(values)))
            yield pd.DataFrame(rows, columns=FIELDS)

    return run(text)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good quality for each pattern. EM over all documents, by the number of each pattern.

    Given the class, rules are independent; a rule has one accuracy on good and one on bad documents, as its chances
    to vote good, to vote bad and to abstain. EM starts from the share of bad votes, which fixes which class is good.
    """
    m = len(RULES)
    votes = patterns[:, None] // 3 ** np.arange(m) % 3
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    post = 0.97 * 0.15 ** (votes == 2).sum(1)
    belief = np.array([[0.2, 0.75, 0.05], [0.3, 0.3, 0.4]])  # of good and of bad: abstains, good, bad
    for _ in range(rounds):
        weights = np.stack([counts * post, counts * (1 - post)])
        seen = np.einsum("cp,pjv->cjv", weights, one_hot) + 2 * belief[:, None, :]
        chance = np.log(seen / seen.sum(2, keepdims=True))
        prior = np.log((weights.sum(1) + [1.6, 0.4]) / (counts.sum() + 2))
        score = prior[:, None] + np.einsum("cjv,pjv->cp", chance, one_hot)
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return post


def rate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality, base_failed, kept.

    The base fails documents of under 50 words or with over half of their words in repeated windows; of the others
    those with a posterior of at least 0.5 are kept. Null text: no words. Rows are judged one by one, whatever their
    ids. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    rows = docs.select("doc_id", measured(F.col("text")).alias("q")).select("doc_id", "q.*")
    rows = scratch.save(rows, "rows")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    seen = rows.groupBy("pattern").count().collect()  # 3 ** rules patterns at most
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.float64)
    post = fit(patterns, counts)
    quality = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post)], "pattern int, quality double")
    joined = rows.join(F.broadcast(quality), "pattern").withColumn("base_failed", base)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("pattern")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"))
