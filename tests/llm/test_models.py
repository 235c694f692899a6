"""The trained models and the pipeline against plain Python that shares no code with them, but for trained weights."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, langid, quality

from .test_operators import LOWER, ROWS, SCHEMA, by_id, words

STRIP = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


# --- language ------------------------------------------------------------------------------------


def slow_means(net, text):
    """Mean probabilities of the labels over a text's bytes, cell by cell as the equations say; context begins anew every STEPS bytes."""
    h, p, raw = langid.UNITS, {k: v.astype(np.float64) for k, v in net.p.items()}, text.encode()
    sig = lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(len(net.langs))
    for at in range(0, len(raw), langid.STEPS):
        part = raw[at : at + langid.STEPS]
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                x, g = p["x" + d][:, part[t]], p["u" + d] @ s + p["c" + d][:, 0]
                z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
                s = (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :]) + z * s
                states[d, t] = s
        for t in range(len(part)):
            e = np.exp(p["o"] @ np.concatenate([states["f", t], states["b", t]]) + p["b"][:, 0])
            total += e / e.sum()
    return total / max(1, len(raw))


def test_reader_is_the_network():
    net = langid.new_net(["a", "b", "c"], 4)
    texts = ["x", "Straße, über " * 9, "y" * 64, "z" * 65, "The end of it. " * 40]
    got = langid.Reader(net).pooled([t.encode() for t in texts])
    assert np.allclose(got, [slow_means(net, t) for t in texts], atol=1e-5)


def test_all_of_many_languages_are_trained(monkeypatch):
    drawn = Counter()

    def record(net, data, label):
        drawn.update(label.tolist())
        return 0.0, {n: np.zeros_like(a) for n, a in net.p.items()}

    monkeypatch.setattr(langid, "gradients", record)
    langid.train([(b"some text", f"l{k:03d}") for k in range(120)], rounds=10)
    assert len(drawn) == 120 and max(drawn.values()) - min(drawn.values()) <= 1


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(spark.createDataFrame([(i, "text", f"l{i % 5}") for i in range(50)], "doc_id long, text string, lang string"))


def test_only_letters_make_a_language(spark):
    net = langid.new_net(["a", "b"], 1)
    texts = ["½ ² Ⅷ ①", "12_34", "", None, "日本", "é", "ª"]
    got = [r.p.lang_pred for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(langid.identify(F.col("text"), net).alias("p")).collect()]
    assert [g == "und" for g in got] == [True] * 4 + [False] * 3


def test_the_network_decides_what_the_stage_keeps(spark):
    texts = ["the of and that with there " * 5, "der und nicht ich auch schön " * 5, "zzzz qqqq xxxx", "12 34", None]
    df = spark.createDataFrame([(k, t, "en", 7) for k, t in enumerate(texts)], "doc_id long, text string, lang string, __p int")
    samples = [(texts[0].encode(), "en"), (texts[1].encode(), "de")]
    good = langid.train(samples, rounds=150)
    ids = lambda net, **k: {r.doc_id for r in langid.known_languages(df, net, **k).collect()}
    assert {0, 1} <= ids(good) <= {0, 1, 2} and ids(good, keep=("de",)) & {0, 1} == {1}
    assert ids(langid.new_net(["de", "en"], 3), min_score=0.9) == set() and ids(None) == set()
    assert langid.known_languages(df, good).columns == df.columns


# --- quality -------------------------------------------------------------------------------------


def votes_of(text):
    """+1 good, -1 bad, 0 none, rule by rule; thresholds are the module's."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    solid, letters = "".join(w), [c for c in "".join(w) if c.isascii() and c.isalpha()]
    raw = solid.encode()
    n_letters = len(letters) + sum(b >= 128 for b in raw)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    grams, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    if not w:
        return [0] * len(quality.RULES)
    stops = len(re.findall(r"[.?!]", text))
    value = {
        "symbols_per_word": symbols / len(w), "marks_per_word": text.count("!") / len(w),
        "upper_share": sum(c.isupper() for c in letters) / n_letters if n_letters else None,
        "dup_line_share": 1 - len(set(lines)) / len(lines) if len(lines) > 1 else None,
        "repeat_share": len(cover) / len(w), "letter_share": n_letters / len(raw), "symbol_share": symbols / len(solid),
        "chars_per_word_far": abs(len(solid) / len(w) - 5.5), "words_per_sentence_far": abs(math.log10(len(w) / max(stops, 0.5) / 10)),
    }
    out = []
    for name, (good, bad) in quality.RULES.items():
        x = value[name]
        up = good <= bad
        out.append(0 if x is None else 1 if (x <= good if up else x >= good) else -1 if (x >= bad if up else x <= bad) else 0)
    return out


def expected_quality(votes):
    """Expectation-maximisation document by document: Dawid and Skene's model of two classes, three answers per rule."""
    post = [0.97 * 0.15 ** v.count(-1) for v in votes]
    belief = {True: {0: 0.2, 1: 0.75, -1: 0.05}, False: {0: 0.3, 1: 0.3, -1: 0.4}}
    for _ in range(200):
        size = {c: sum(p if c else 1 - p for p in post) for c in (True, False)}
        prior = {True: (size[True] + 1.6) / (len(votes) + 2), False: (size[False] + 0.4) / (len(votes) + 2)}
        chance = {
            (c, j, a): (sum((p if c else 1 - p) for p, v in zip(post, votes) if v[j] == a) + 2 * belief[c][a]) / (size[c] + 2)
            for c in (True, False) for j in range(len(votes[0])) for a in (0, 1, -1)
        }
        new = []
        for v in votes:
            like = {c: prior[c] * math.prod(chance[c, j, a] for j, a in enumerate(v)) for c in (True, False)}
            new.append(like[True] / (like[True] + like[False]))
        moved, post = max(abs(a - b) for a, b in zip(post, new)), new
        if moved < 1e-9:
            break
    return post


def test_quality_by_expectation_maximisation(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = list(ROWS)
    for k in range(60):  # texts that fail some rules
        ws = [f"{'W#%' if k % 3 == 0 else 'GO!!' if k % 3 == 1 else 'x9'}{rng.integers(1000)}" for _ in range(rng.integers(55, 90))]
        rows.append((1000 + k, " ".join(ws) + ("\nsame line\nsame line" * (k % 4)), "en", "s", 0, 0, 0, 0, 0))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "d"))
    got = by_id(quality.rate(spark.read.parquet(str(tmp_path / "d"))))
    want = expected_quality([votes_of(r[1]) for r in rows])
    for r, q in zip(rows, want):
        assert math.isclose(got[r[0]].quality, q, abs_tol=1e-6), r[0]
        assert got[r[0]].kept == (not got[r[0]].base_failed and q >= 0.5)
    kept = [got[r[0]].kept for r in rows if not got[r[0]].base_failed]
    assert 10 < sum(kept) < len(kept) - 10


# --- pipeline ------------------------------------------------------------------------------------


def brute_pipeline(spark, docs, rows):
    """doc_id, n_tokens and hashes of what run() returns, from the contracts of its stages."""
    net = langid.learn(docs)
    kept = []
    for r in rows:  # language ID
        if r[1] and re.search(r"[^\W\d_]", r[1]) and slow_means(net, r[1]).max() >= langid.MIN_SCORE:
            kept.append(r)
    holders = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    for r in kept:
        for line in r[1].split("\n"):
            holders[key(line)].add(r[0])
    common = {k for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    kept = [(r[0], "\n".join(x for x in r[1].split("\n") if key(x) not in common or max(holders[key(x)]) == r[0]), *r[2:]) for r in kept]
    sets = []
    for r in kept:
        w = words(r[1].translate(LOWER))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    kept = [r for k, r in enumerate(kept) if r[0] == min(x[0] for x, y in zip(kept, label) if y == label[k])]
    ids = [r[0] for r in kept]
    hashed = dict(spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.xxhash64(F.lit(17), "doc_id")).collect())
    size = {r[0]: len(words(r[1])) for r in kept}
    per = Counter()
    for r in kept:
        per[r[3]] += size[r[0]]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted((s for s in per if s is not None)) + [None] * (None in per))}
    capped = set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        level = (sum(per.values()) - sum(3 * per[s] for s in capped)) / free
        more = {s for s in per if s not in capped and weight[s] * level > 3 * per[s]}
        if not more:
            break
        capped |= more
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(bpe.vocabulary()), []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for s in per:
        target = 3 * per[s] if s in capped else weight[s] * level
        rate = target / per[s] if per[s] else 0
        seen = 0
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashed[r[0]]):
            seen += size[r[0]]
            more = size[r[0]] and seen - size[r[0]] / 2 < (rate - math.floor(rate + 1e-12)) * per[s]
            got = tok.encode(r[1], add_special_tokens=False).ids
            out += [(r[0], len(got), sha(",".join(map(str, got))), sha(tok.decode(got, skip_special_tokens=False)))] * (math.floor(rate + 1e-12) + bool(more))
    return sorted(out)


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), ROWS)
    assert got == want and len({r[0] for r in got}) < len(ROWS) - 10


def test_held_out_folds(docs):
    got = by_id(langid.languages(docs))
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
