"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in pieces of PIECE bytes, both ways, labels every position with a
distribution over the languages, and a document's distribution is the mean over the positions of
its letters. It is trained in numpy by backpropagation through time (Adam) on windows of a
sample of labelled rows: about SAMPLE documents a language (of more than MANY languages fewer,
LEAST at least), chosen by a hash of the text over all of the table, each text once, and of each at most SAMPLE_CHARS characters from a place that the hash
names. Every language that a labelled row names is learned. Predictions read every byte of every text.

The unit is minimally gated: one gate g, state h' = h + g * (c - h), candidate
c = tanh(x + g * (U h)).

Memory: a batch of texts, cut to matrices of BATCH pieces at a time (of fewer with more than MANY
languages); the driver holds the sample.

Defined cases: texts that are null or have no letter get `und` and score 0; ties go to the
language first in order; with no labelled rows nothing is learned and every text is `und`;
repeated rows get equal predictions; an empty table gives an empty result; extra columns are
kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches

SAMPLE, SAMPLE_CHARS, MANY, LEAST = 250, 3000, 200, 20
HIDDEN, PIECE, BATCH, STEPS, TRAIN_BATCH, TRAIN_PIECE, RATE, SEED = 12, 64, 2048, 260, 256, 32, 0.02, 7
UNKNOWN = "und"
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@dataclass
class Network:
    """x: what a byte adds, per direction (256 x 2H: gate, candidate); u: H x 2H; v: 2H x languages."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.tanh(a * np.float32(0.5), out=a)
    a *= np.float32(0.5)
    a += np.float32(0.5)
    return a


def _run(pieces: np.ndarray, x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each position, of pieces (T x B bytes, in the order read): T x B x H."""
    steps, batch = pieces.shape
    size = u.shape[0]
    h = np.zeros((batch, size), dtype=x.dtype)
    out = np.empty((steps, batch, size), dtype=x.dtype)
    for t in range(steps):
        a, r = x[pieces[t]], h @ u
        g = _sigmoid(a[:, :size] + r[:, :size])
        c = np.tanh(a[:, size:] + g * r[:, size:])
        if keep is not None:
            keep.append((h, g, c, r[:, size:]))
        h = h + g * (c - h)
        out[t] = h
    return out


def _softmax(a: np.ndarray) -> np.ndarray:
    a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-1, keepdims=True)
    return a


def gradients(weights: list[np.ndarray], pieces: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean cross entropy over the letters of pieces (T x B bytes) with labels y, by backpropagation through time."""
    (steps, batch), size = pieces.shape, weights[1].shape[1]
    kept: list = [[], []]
    states = [_run(pieces, weights[0][0], weights[1][0], kept[0]), _run(pieces[::-1], weights[0][1], weights[1][1], kept[1])]
    both = np.concatenate([states[0], states[1][::-1]], axis=2)
    p = _softmax(both @ weights[2] + weights[3])
    mask = LETTER[pieces].astype(p.dtype)
    p[np.arange(steps)[:, None], np.arange(batch)[None, :], y[None, :]] -= 1
    p *= (mask / max(1.0, float(mask.sum())))[:, :, None]
    grads = [np.zeros_like(weights[0]), np.zeros_like(weights[1]), np.einsum("tbh,tbk->hk", both, p, optimize=True), p.sum(axis=(0, 1))]
    back = p @ weights[2].T
    for d, read in ((0, pieces), (1, pieces[::-1])):
        dout = back[:, :, :size] if d == 0 else back[::-1, :, size:]
        dh, u = np.zeros((batch, size), dtype=p.dtype), weights[1][d]
        for t in range(steps - 1, -1, -1):
            h, g, c, r = kept[d][t]
            dh = dh + dout[t]
            dc = dh * g * (1 - c * c)
            dg = (dh * (c - h) + dc * r) * g * (1 - g)
            da = np.concatenate([dg, dc], axis=1)
            dr = np.concatenate([dg, dc * g], axis=1)
            grads[1][d] += h.T @ dr
            np.add.at(grads[0][d], read[t], da)
            dh = dh * (1 - g) + dr @ u.T
    return grads


def train(texts: list[bytes], labels: list[int], languages: list[str]) -> Network:
    rng, size, classes = np.random.default_rng(SEED), HIDDEN, len(languages)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    weights = [draw(2, 256, 2 * size, by=0.3), draw(2, size, 2 * size, by=size**-0.5), draw(2 * size, classes, by=0.3), np.zeros(classes, dtype=np.float32)]
    weights[0][:, :, :size] -= 0.5
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    usable = [(np.frombuffer(t, dtype=np.uint8), y) for t, y in zip(texts, labels, strict=True) if t]
    of = [[t for t, y in usable if y == k] for k in range(classes)]
    of = [[np.concatenate([t, np.full(max(0, TRAIN_PIECE - len(t)), 32, dtype=np.uint8)]) for t in ts] for ts in of]
    known = [k for k in range(classes) if of[k]]
    for step in range(STEPS):
        y = rng.choice(known, TRAIN_BATCH)
        pieces = np.empty((TRAIN_PIECE, TRAIN_BATCH), dtype=np.uint8)
        for i, k in enumerate(y):
            t = of[k][rng.integers(len(of[k]))]
            at = rng.integers(len(t) - TRAIN_PIECE + 1)
            pieces[:, i] = t[at : at + TRAIN_PIECE]
        grads = gradients(weights, pieces, y)
        rate = RATE * min(1.0, (STEPS - step) / (0.5 * STEPS))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            np.clip(g, -0.5, 0.5, out=g)
            m *= 0.9
            m += 0.1 * g
            v *= 0.98
            v += 0.02 * g * g
            w -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.98 ** (step + 1))) + 1e-8)
    return Network(languages, weights[0], weights[1], weights[2], weights[3])


def position_sums(net: Network, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (B x PIECE bytes): summed distributions over the positions of letters, and their number."""
    read = np.ascontiguousarray(pieces.T)
    size, steps = net.u.shape[1], len(read)
    ahead = _run(read, net.x[0], net.u[0]) @ net.v[:size] + net.c
    ahead += (_run(read[::-1], net.x[1], net.u[1]) @ net.v[size:])[::-1]
    mask = LETTER[read]
    ahead = _softmax(ahead)
    ahead *= mask[:, :, None]
    return ahead.sum(axis=0, dtype=np.float64), mask.sum(axis=0)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not net.languages:
        return names, scores
    usable = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    pooled, letters = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    most = max(1, BATCH * MANY // max(MANY, len(net.languages)))
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def label() -> None:
        sums, number = position_sums(net, np.stack(waiting))
        np.add.at(pooled, owners, sums)
        np.add.at(letters, owners, number)
        waiting.clear()
        owners.clear()

    for i in usable:
        read = np.frombuffer(texts[i].encode("utf-8", "replace"), dtype=np.uint8)
        cut = np.full((-(-len(read) // PIECE), PIECE), 32, dtype=np.uint8)
        cut.reshape(-1)[: len(read)] = read
        for row in cut:
            waiting.append(row)
            owners.append(i)
            if len(waiting) == most:
                label()
    if waiting:
        label()
    for i in usable:
        p = pooled[i] / max(1, letters[i])
        names[i], scores[i] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
    return names, scores


def fit(labelled: DataFrame) -> Network:
    """Network from a bounded sample of labelled: text, lang. Only the sample reaches the driver."""
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    h = F.xxhash64("text", F.lit(SEED))
    # Distinct texts, or a language of few texts beside a large group of copies would get a share of its rows and hardly a text.
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.countDistinct(h).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([], *[np.zeros(0)] * 4)
    each = min(SAMPLE, max(LEAST, SAMPLE * MANY // len(languages)))
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, each / counts[k])) for k in languages], "lang string, share double")
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    chosen = usable.join(F.broadcast(shares), "lang").withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    chosen = chosen.select("lang", "h", F.substring(F.col("text"), (F.pmod(F.shiftright("h", 20), room + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    chosen = chosen.groupBy("h", "lang").agg(F.min("text").alias("text"))  # copies of a text count once, or a large group of them would fill the sample
    rows = sorted((r["h"], r["lang"], r["text"]) for r in chosen.orderBy("h", "lang").limit(2 * each * len(languages)).collect())
    number = {k: i for i, k in enumerate(languages)}
    return train([t.encode("utf-8", "replace") for _, _, t in rows], [number[k] for _, k, _ in rows], languages)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """docs with lang_pred and score, from text alone."""
    small_batches(docs.sparkSession)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(kind)
    def label(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(net, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.drop("lang_pred", "score").withColumn("__p", label("text"))
    return rows.select(*[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")], "__p.lang_pred", "__p.score")


def digest(docs: DataFrame) -> DataFrame:
    net = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
