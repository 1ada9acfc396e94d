"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from all labelled training rows: words, and beginnings of words, whose share of documents is far larger
among toxic ones by a likelihood ratio, with a weight each. Features of a text: lexicon hits (number, density, distinct, weighted, densest stretch), hits near
second-person words, hits that only show after undoing look-alike characters or spacing, capitals, punctuation,
exclamation marks, obfuscated and repeated words, length. Trees are grown on histograms of at most ``BINS`` bins in numpy on
at most about ``TRAIN_ROWS`` labelled rows (a parameter); one fold of them isn't used by the trees and fits the calibration.

Defined cases: null text is empty; an empty text is scored like any text; without labelled rows of both classes the score
is the share of toxic labels, or 0; each input row gives one row; several labels of one document: the largest.
Only doc_id, text and toxic are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.llm.common import stored, words

LEXICON, BINS, TREES, DEPTH, RATE = 400, 64, 80, 3, 0.15
# A lexicon entry that ends in * stands for all words that begin so.
BEGINNINGS = (4, 5)
LEAST_RATIO, LEAST_WEIGHT = 20.0, 2.0
TRAIN_ROWS = 40_000
THRESHOLD = 0.7
# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes ti tú vosotros os tuyo tuya".split())
NEAR, STRETCH = 6, 50
_LOOKALIKE = str.maketrans("013457@$!|€", "oieastasiie")
_SEPARATORS = dict.fromkeys(map(ord, ".-_*~'`"))
_ODD = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[\d@$!|€.\-_*~'`]+[^\W\d_]+)+|(?<!\w)[@$|!\d€]+[^\W\d_]+|(?:(?<!\w)[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W_]+")
FEATURES = 15


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """entry -> weight: what tells toxic documents from others best; ``size`` bounds what reaches the driver."""
    total = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, c = int(total["t"] or 0), int(total["n"]) - int(total["t"] or 0)
    if not t or not c:
        return {}
    w = words(F.lower("text"))
    begun = [F.transform(F.filter(w, lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.left(x, F.lit(k)), F.lit("*")))
             for k in BEGINNINGS]
    by_entry = labelled.select("toxic", F.explode_outer(F.array_distinct(F.concat(w, *begun))).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).where("a >= 3 AND word IS NOT NULL")
    a, b = F.col("a"), F.col("n") - F.col("a")
    weight = F.log((a + 0.5) / (t - a + 0.5)) - F.log((b + 0.5) / (c - b + 0.5))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share = F.col("n") / float(t + c)
    ratio = 2 * (part(a, t * share) + part(t - a, t * (1 - share)) + part(b, c * share) + part(c - b, c * (1 - share)))
    best = by_entry.select("word", weight.alias("w"), ratio.alias("r")).where(
        (F.col("r") > LEAST_RATIO) & (F.col("w") > LEAST_WEIGHT)).orderBy(F.desc("r"), "word").limit(size).collect()
    return {r["word"]: float(r["w"]) for r in best}


def weight_of(word: str, lex: dict[str, float]) -> float:
    """The entry of the word itself, else of its longest beginning; 0 if there is none."""
    found = lex.get(word)
    for k in reversed(BEGINNINGS):
        if found is None and len(word) > k:
            found = lex.get(word[:k] + "*")
    return found or 0.0


def features(text: str | None, lex: dict[str, float]) -> list[float]:
    text = text or ""
    low = text.lower()
    tokens = _WORD.findall(low)
    n = max(1, len(tokens))
    found = {w: v for w in set(tokens) if (v := weight_of(w, lex))}
    at = [i for i, w in enumerate(tokens) if w in found] if found else []
    you = [i for i, w in enumerate(tokens) if w in SECOND_PERSON] if at else []
    spots = np.searchsorted(you, at) if you else []
    near = sum(1 for i, s in zip(at, spots) if (s < len(you) and you[s] - i <= NEAR) or (s > 0 and i - you[s - 1] <= NEAR))
    densest = max((np.searchsorted(at, np.array(at) + STRETCH) - np.arange(len(at))).tolist(), default=0)
    hidden = odd = 0
    for m in _ODD.finditer(low):
        odd += 1
        plain = m.group().translate(_SEPARATORS).replace(" ", "").translate(_LOOKALIKE)
        hidden += bool(weight_of(plain, lex) or weight_of(_REPEAT.sub(r"\1", plain), lex)) and not weight_of(m.group(), lex)
    repeats = _REPEAT.findall(low)
    raw = text.encode()
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    size = max(1, len(raw))
    return [len(at), len(at) / n, len({tokens[i] for i in at}), sum(found[tokens[i]] for i in at), sum(found[tokens[i]] for i in at) / n,
            densest, near, near / n, hidden, hidden / n, capitals / size, marks / size, raw.count(b"!") / size,
            (odd + len(repeats)) / n, np.log1p(len(tokens))]


def with_features(docs: DataFrame, lex: dict[str, float], into: str = "features") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[float(v) for v in features(t, lex)] for t in s])

    return docs.withColumn(into, run(F.col("text")))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full tree of DEPTH levels: feature and threshold bin of each inner node, value of each leaf."""
    node = np.zeros(len(x), np.int64)
    feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, n_bins)
    for level in range(DEPTH):
        k = 1 << level
        gain = np.full((k, x.shape[1], n_bins), -np.inf)
        for j in range(x.shape[1]):
            key = node * n_bins + x[:, j]
            g, h, c = (np.bincount(key, w, k * n_bins).reshape(k, n_bins) for w in (grad, hess, None))
            gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
            gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
            ok = (cl >= 5) & (ct - cl >= 5)
            gain[:, j] = np.where(ok, gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1), -np.inf)
        best = gain.reshape(k, -1).argmax(1)
        top = gain.reshape(k, -1).max(1)
        for i in range(k):
            if top[i] > 1e-6:
                feature[k - 1 + i], cut[k - 1 + i] = divmod(int(best[i]), n_bins)
        here = k - 1 + node
        node = 2 * node + (x[np.arange(len(x)), feature[here]] > cut[here])
    g, h = np.bincount(node, grad, 1 << DEPTH), np.bincount(node, hess, 1 << DEPTH)
    return feature, cut, -g / (h + 1)


def leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for level in range(DEPTH):
        here = (1 << level) - 1 + node
        node = 2 * node + (x[np.arange(len(x)), feature[here]] > cut[here])
    return node


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and values of a rising step line, a label of either class added to each block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    places = [p for b in blocks for p in (b[2], b[3])]
    values = [v for b in blocks for v in [(b[0] + 0.5) / (b[1] + 1)] * 2]
    return np.array(places), np.maximum.accumulate(values)


def fit(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> dict:
    """Boost log loss on the rows outside ``calibration``, then calibrate on those inside."""
    own = ~calibration
    if len(set(y[own])) < 2 or len(set(y[calibration])) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    edges = [np.unique(np.quantile(x[own, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    b, t = _bins(x, edges), y[own]
    n_bins = BINS + 1
    base = np.log(t.mean() / (1 - t.mean()))
    f, trees = np.full(len(x), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f[own]))
        feature, cut, value = grow(b[own], p - t, p * (1 - p), n_bins)
        trees.append((feature, cut, RATE * value))
        f += RATE * value[leaf(b, feature, cut)]
    places, values = isotonic(f[calibration], y[calibration])
    return {"edges": edges, "base": base, "trees": trees, "places": places, "values": values}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    b, f = _bins(x, model["edges"]), np.full(len(x), model["base"])
    for feature, cut, value in model["trees"]:
        f += value[leaf(b, feature, cut)]
    return np.clip(np.interp(f, model["places"], model["values"]), 0.0, 1.0)


def with_score(featured: DataFrame, model: dict, into: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score(np.array(s.tolist(), np.float64).reshape(len(s), FEATURES), model))

    return featured.withColumn(into, run(F.col("features")))


def learn_and_score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, features, score of every row of docs, learned from ``labels`` (doc_id, toxic) of documents in docs."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # One plan for every size: labels grow with the documents, so they aren't broadcast while they happen to be small.
    lex = lexicon(docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("text", "toxic"))
    featured = stored(with_features(docs.select("doc_id", "text"), lex).select("doc_id", "features"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = featured.join(known.where(draw * max(n, 1) < train_rows), "doc_id").orderBy("doc_id").select(
        "features", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("calibration")).toPandas()
    model = fit(np.array(rows["features"].tolist(), np.float64).reshape(len(rows), FEATURES),
                rows["toxic"].to_numpy(np.float64), rows["calibration"].to_numpy(bool))
    return with_score(featured, model)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(3) != 1)
    return learn_and_score(docs, labels).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
