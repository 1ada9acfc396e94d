"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths run over a fixed window of bytes; each filter's largest response feeds a
softmax over the languages. Training takes ``PER_LANGUAGE`` documents of each language, picked by a hash, and
``WINDOWS`` windows of each (both parameters; the label decides nothing but the class). A prediction averages the
probabilities of all windows of the whole text, weighted by their bytes.

Defined cases: null text and text without a letter are ``und`` with score 0; without any training row every text is ``und``;
each input row gives one row and keeps its columns; ties go to the language that sorts first. Only text is read to predict,
text, lang and doc_id to train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.llm.common import broadcast_checked

WIDTH = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
PER_LANGUAGE, WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 8, 64, 0.004
UNKNOWN = "und"


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> list:
    """(lang, piece): windows of about per_language documents of each language, evenly spread over their texts."""
    known = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    total = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(broadcast_checked(total), "lang").where(draw * F.col("n") < per_language)
    span = F.greatest(F.char_length("text") - WIDTH, F.lit(0))
    places = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.floor(span * i / max(windows - 1, 1)).cast("int"))
    return picked.select("doc_id", "lang", F.explode(F.array_distinct(places)).alias("at"), "text").select(
        "doc_id", "at", "lang", F.substring("text", F.col("at") + 1, F.lit(WIDTH)).alias("piece")).orderBy(
        "doc_id", "at", "lang", "piece").collect()


def as_bytes(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p[:WIDTH].ljust(WIDTH, b"\0") for p in pieces), np.uint8).reshape(-1, WIDTH)


def responses(x: np.ndarray, m: dict) -> list[np.ndarray]:
    """Filter responses before pooling, (texts, places, filters) for each width."""
    e = m["embed"][x]
    out = []
    for w, k, b in zip(WIDTHS, m["kernels"], m["bias"]):
        view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2)
        out.append(view.reshape(-1, w * EMBED) @ k + b)
        out[-1] = out[-1].reshape(len(x), -1, FILTERS)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list, seed: int = 7) -> dict:
    """Adam on cross entropy; the gradient of max pooling reaches the winning place of each filter only."""
    names = sorted({r["lang"] for r in rows})
    if not names:
        return {"names": []}
    x = as_bytes([r["piece"].encode() for r in rows])
    y = np.array([names.index(r["lang"]) for r in rows])
    rng = np.random.default_rng(seed)
    m = {"names": names, "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
         "kernels": [rng.normal(0, 0.25, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
         "bias": [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
         "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32),
         "out_bias": np.zeros(len(names), np.float32)}
    flat = [m["embed"], *m["kernels"], *m["bias"], m["out"], m["out_bias"]]
    first, second, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            i = order[at:at + BATCH]
            xb, n = x[i], len(i)
            z = responses(xb, m)
            place = [r.argmax(axis=1) for r in z]
            top = np.concatenate([np.take_along_axis(r, p[:, None], 1)[:, 0] for r, p in zip(z, place)], axis=1)
            h = np.maximum(top, 0)
            d = softmax(h @ m["out"] + m["out_bias"])
            d[np.arange(n), y[i]] -= 1
            d /= n
            dh = (d @ m["out"].T) * (top > 0)
            grads = [np.zeros_like(m["embed"])]
            kernels, biases = [], []
            for j, (w, k, p) in enumerate(zip(WIDTHS, m["kernels"], place)):
                g = dh[:, j * FILTERS:(j + 1) * FILTERS]
                seen = xb[np.arange(n)[:, None, None], p[:, :, None] + np.arange(w)]
                kernels.append(np.einsum("nf,nfwe->wef", g, m["embed"][seen]).reshape(w * EMBED, FILTERS))
                biases.append(g.sum(axis=0))
                back = g[:, :, None, None] * k.reshape(w, EMBED, FILTERS).transpose(2, 0, 1)
                np.add.at(grads[0], seen, back)
            grads += [*kernels, *biases, h.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(flat, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return m


def probabilities(pieces: np.ndarray, m: dict) -> np.ndarray:
    h = np.concatenate([r.max(axis=1) for r in responses(pieces, m)], axis=1)
    return softmax(np.maximum(h, 0) @ m["out"] + m["out_bias"])


def judge(texts: list[str | None], m: dict, at_once: int = 512) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of many texts are batched, those of one text add up."""
    known = [t is not None and bool(m["names"]) and any(map(str.isalpha, t)) for t in texts]
    sums = np.zeros((len(texts), max(1, len(m["names"]))))
    pieces: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        if pieces:
            weight = np.array([len(p) for p in pieces], np.float64)
            np.add.at(sums, owner, probabilities(as_bytes(pieces), m) * weight[:, None])
            pieces.clear()
            owner.clear()

    for i, t in enumerate(texts):
        if known[i]:
            b = t.encode()
            for at in range(0, len(b), WIDTH):
                pieces.append(b[at:at + WIDTH])
                owner.append(i)
                if len(pieces) == at_once:
                    flush()
    flush()
    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
    best = share.argmax(axis=1)
    return ([m["names"][b] if k else UNKNOWN for b, k in zip(best, known)],
            [float(min(1.0, share[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))])


def predict(docs: DataFrame, m: dict, into: str = "language") -> DataFrame:
    """Add struct column ``into`` (lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = judge(s.tolist(), m)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(into, run(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    m = train(sample(docs.where(fold(4) != 2)))
    return predict(docs.select("doc_id", "text"), m).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "language.lang_pred", "language.score")
