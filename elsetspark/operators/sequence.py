"""A recurrent scorer for the sequence-model detector, trained by Spark: bidirectional LSTM layers and a logit a token.

Tokens of a window come together in one row (TOKENS of them at most), so that a network reads whole
windows inside mapInPandas. A training step is one job over one batch of windows: every task sums
the loss and the gradients of its windows over time, further tasks add up those sums, and the driver
takes at most FAN of them, each as large as the weights, and moves the weights. Windows are written
once, by batch, so that a step reads its own batch alone; a lost executor costs its tasks of one step.

Defined cases: a window shorter than TOKENS is padded with zeros, which are read as tokens and never
counted; tokens that are not valid do not count in the loss and score 0; without a valid token loss
and gradients are zero; the same windows, seed and partitioning give the same weights up to the order in which sums are added.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partition
from .features import CHANNELS, TOKENS, channels, class_quartiles, scaler_document, scaler_of, standardise, token_windows
from .learned import detect_learned
from .ordered import kept

#: Sums of gradients that reach the driver in a step at most, and windows that a task runs at once.
FAN, AT_ONCE = 16, 128
Weights = dict[str, np.ndarray]
SUMS = "loss double, n double, gradient binary"


@dataclass(frozen=True)
class Network:
    """Shape of the network; dropout acts between layers, in training only."""

    n_channels: int = len(CHANNELS)
    hidden_size: int = 64
    num_layers: int = 2
    dropout: float = 0.1

    def __post_init__(self) -> None:
        if min(self.n_channels, self.hidden_size, self.num_layers) < 1 or not 0 <= self.dropout < 1:
            raise ValueError(f"channels, hidden size and layers of at least 1 and a dropout in [0, 1) are needed, got {self}")

    def start(self, seed: int) -> Weights:
        """Weights drawn evenly within 1 / sqrt(hidden size)."""
        rng, h, out = np.random.default_rng(seed), self.hidden_size, {}
        for layer in range(self.num_layers):
            wide = self.n_channels if layer == 0 else 2 * h
            for way in ("ahead", "back"):
                for name, shape in (("x", (wide, 4 * h)), ("h", (h, 4 * h)), ("b", (4 * h,))):
                    out[f"{way}{layer}.{name}"] = rng.uniform(-1, 1, shape) / math.sqrt(h)
        return out | {"head.w": rng.uniform(-1, 1, 2 * h) / math.sqrt(2 * h), "head.b": np.zeros(1)}


@dataclass(frozen=True)
class Training:
    """How the weights move. decoupled: weight decay apart from the gradient; schedule: fixed, or warm-up to a cosine; focal_gamma above 0: focal loss."""

    rate: float = 1e-3
    positive_weight: float = 10.0
    weight_decay: float = 0.0
    decoupled: bool = False
    cosine: bool = False
    warm_up: float = 0.0
    focal_gamma: float = 0.0
    epochs: int = 10
    batches: int = 8
    seed: int = 0

    def __post_init__(self) -> None:
        if self.rate <= 0 or self.positive_weight <= 0 or min(self.weight_decay, self.focal_gamma) < 0 or not 0 <= self.warm_up < 1 or min(self.epochs, self.batches) < 1:
            raise ValueError(f"settings of the training out of range: {self}")

    def scale(self, step: int, steps: int) -> float:
        """Share of the rate at a step."""
        if not self.cosine:
            return 1.0
        warm = min(int(self.warm_up * steps), steps - 1)
        if step < warm:
            return (step + 1) / (warm + 1)
        return 0.5 * (1 + math.cos(math.pi * min((step - warm) / max(1, steps - warm), 1.0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _run(x: np.ndarray, weights: Weights, name: str) -> tuple[np.ndarray, tuple]:
    """Hidden states (windows, time, hidden) of one direction, and what its gradient needs."""
    windows, length, _ = x.shape
    own = weights[f"{name}.h"].shape[0]
    drive = x @ weights[f"{name}.x"] + weights[f"{name}.b"]
    h, c = np.zeros((windows, own)), np.zeros((windows, own))
    states, cells, gates = np.zeros((windows, length, own)), np.zeros((windows, length, own)), np.zeros((windows, length, 4 * own))
    for t in range(length):
        z = drive[:, t] + h @ weights[f"{name}.h"]
        i, f, o, g = sigmoid(z[:, :own]), sigmoid(z[:, own : 2 * own]), sigmoid(z[:, 2 * own : 3 * own]), np.tanh(z[:, 3 * own :])
        c = f * c + i * g
        h = o * np.tanh(c)
        states[:, t], cells[:, t], gates[:, t] = h, c, np.concatenate([i, f, o, g], axis=1)
    return states, (x, states, cells, gates)


def _run_back(up: np.ndarray, held: tuple, weights: Weights, name: str, out: Weights) -> np.ndarray:
    """Adds the gradients of one direction to out; returns that of its input. up: gradient of the hidden states."""
    x, states, cells, gates = held
    windows, length, own = states.shape
    inner, dh, dc = np.zeros_like(gates), np.zeros((windows, own)), np.zeros((windows, own))
    for t in range(length - 1, -1, -1):
        i, f, o, g = np.split(gates[:, t], 4, axis=1)
        bent, before = np.tanh(cells[:, t]), cells[:, t - 1] if t else np.zeros((windows, own))
        dh = dh + up[:, t]
        dc = dc + dh * o * (1 - bent * bent)
        inner[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dh, dc = inner[:, t] @ weights[f"{name}.h"].T, dc * f
    earlier = np.concatenate([np.zeros((windows, 1, own)), states[:, :-1]], axis=1)
    out[f"{name}.x"] += np.einsum("wtc,wtg->cg", x, inner, optimize=True)
    out[f"{name}.h"] += np.einsum("wtc,wtg->cg", earlier, inner, optimize=True)
    out[f"{name}.b"] += inner.sum(axis=(0, 1))
    return inner @ weights[f"{name}.x"].T


def forward(x: np.ndarray, weights: Weights, network: Network, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """Logits (windows, time) and what the gradient needs. rng: draws the dropout, in training."""
    held = []
    for layer in range(network.num_layers):
        mask = None
        if layer and rng is not None and network.dropout:
            mask = (rng.random(x.shape) >= network.dropout) / (1 - network.dropout)
            x = x * mask
        ahead, a = _run(x, weights, f"ahead{layer}")
        back, b = _run(x[:, ::-1], weights, f"back{layer}")
        x = np.concatenate([ahead, back[:, ::-1]], axis=2)
        held.append((a, b, mask))
    return x @ weights["head.w"] + weights["head.b"], [*held, x]


def backward(up: np.ndarray, held: list, weights: Weights, network: Network) -> Weights:
    """Gradients of the weights. up: gradient of the logits."""
    out = {k: np.zeros_like(v) for k, v in weights.items()}
    *layers, top = held
    out["head.w"], out["head.b"] = np.einsum("wt,wth->h", up, top), np.array([up.sum()])
    down, own = up[:, :, None] * weights["head.w"], network.hidden_size
    for layer in range(network.num_layers - 1, -1, -1):
        a, b, mask = layers[layer]
        down = _run_back(down[:, :, :own], a, weights, f"ahead{layer}", out) + _run_back(down[:, ::-1, own:], b, weights, f"back{layer}", out)[:, ::-1]
        if mask is not None:
            down = down * mask
    return out


def token_loss(logits: np.ndarray, target: np.ndarray, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each token and its slope: cross-entropy with a weight on manoeuvres, times (1 - probability of the truth) ** focal_gamma."""
    sign = 2 * target - 1
    p = sigmoid(sign * logits)  # of the truth
    weight, entropy = np.where(target > 0, how.positive_weight, 1.0), np.logaddexp(0, -sign * logits)
    if not how.focal_gamma:
        return weight * entropy, -weight * sign * (1 - p)
    focus = (1 - p) ** how.focal_gamma
    return weight * focus * entropy, -weight * sign * focus * (how.focal_gamma * p * entropy + 1 - p)


# Windows as rows


def windows(tokens: DataFrame) -> DataFrame:
    """One row a window of token_windows: norad_id, window_id, and in order of position the arrays position, idx, valid, target (0 where tokens have none) and x."""
    value = F.struct(F.col("position").cast("int").alias("position"), F.col("idx").cast("long").alias("idx"), (F.col("elset_valid") > 0).alias("valid"), (F.col("target") if "target" in tokens.columns else F.lit(0.0)).cast("double").alias("target"), F.array(*[F.col(c).cast("float") for c in CHANNELS]).alias("x"))
    rows = tokens.groupBy("norad_id", "window_id").agg(F.array_sort(F.collect_list(value)).alias("g"))
    return rows.select("norad_id", F.col("window_id").cast("long").alias("window_id"), "g.position", "g.idx", "g.valid", "g.target", F.flatten("g.x").alias("x"))


def _dense(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Channels, validity and targets of windows, padded to length."""
    wide = len(rows["x"].iloc[0]) // len(rows["position"].iloc[0])
    x, valid, target = np.zeros((len(rows), length, wide)), np.zeros((len(rows), length), dtype=bool), np.zeros((len(rows), length))
    for k, (at, v, y, values) in enumerate(zip(rows["position"], rows["valid"], rows["target"], rows["x"], strict=True)):
        x[k, at], valid[k, at], target[k, at] = np.asarray(values).reshape(-1, wide), v, y
    return x, valid, target


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpacked(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    loss, n, gradient = 0.0, 0.0, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = np.frombuffer(row.gradient, dtype="<f8")
            loss, n, gradient = loss + row.loss, n + row.n, own.copy() if gradient is None else gradient + own
    if gradient is not None:
        yield pd.DataFrame({"loss": [loss], "n": [n], "gradient": [gradient.astype("<f8").tobytes()]})


def sums(rows: DataFrame, weights: Weights, network: Network, how: Training, step: int | None = None, length: int = TOKENS) -> tuple[float, float, np.ndarray]:
    """Loss and gradient summed over the valid tokens of windows, and their number. step: with dropout drawn for it; none: without, and no gradient."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n, gradient = 0.0, 0.0, np.zeros(sum(v.size for v in weights.values()) if step is not None else 0)
        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):
                some = batch.iloc[lo : lo + AT_ONCE]
                x, valid, target = _dense(some, length)
                named = (int(some["norad_id"].iloc[0]) & 0xFFFFFFFF, int(some["window_id"].iloc[0]) & 0xFFFFFFFF)
                rng = None if step is None else np.random.default_rng([how.seed, step, *named])
                logits, held = forward(x, weights, network, rng)
                each_token, slope = token_loss(logits, target, how)
                loss, n = loss + float((each_token * valid).sum()), n + float(valid.sum())
                if step is not None:
                    gradient += packed(backward(slope * valid, held, weights, network))
        if n:
            yield pd.DataFrame({"loss": [loss], "n": [n], "gradient": [gradient.astype("<f8").tobytes()]})

    found = rows.mapInPandas(each, SUMS)
    parts = [r.asDict() for r in found.repartition(FAN).mapInPandas(_added, SUMS).collect()]  # FAN rows at most
    if not parts:
        return 0.0, 0.0, np.zeros(sum(v.size for v in weights.values()))
    return sum(r["loss"] for r in parts), sum(r["n"] for r in parts), np.sum([np.frombuffer(r["gradient"], dtype="<f8") for r in parts], axis=0)


class Adam:
    """Moments of the gradient, by which the weights move."""

    def __init__(self, size: int, how: Training):
        self.how, self.first, self.second, self.n = how, np.zeros(size), np.zeros(size), 0

    def moved(self, flat: np.ndarray, gradient: np.ndarray, scale: float) -> np.ndarray:
        rate, decay = self.how.rate * scale, self.how.weight_decay
        if self.how.decoupled:
            flat = flat * (1 - rate * decay)
        else:
            gradient = gradient + decay * flat
        self.n += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        return flat - rate * (self.first / (1 - 0.9**self.n)) / (np.sqrt(self.second / (1 - 0.999**self.n)) + 1e-8)


def train(rows: DataFrame, network: Network, how: Training, held_out: DataFrame | None = None, length: int = TOKENS) -> tuple[Weights, list[dict]]:
    """Weights after all epochs, or of the epoch with the least loss on held_out, and the mean losses of each epoch."""
    batch = F.pmod(F.xxhash64("norad_id", "window_id"), F.lit(how.batches)).cast("int")
    stored, beside = kept(rows.withColumn("batch", batch), by="batch"), None if held_out is None else kept(held_out)
    weights = network.start(how.seed)
    adam, rng, steps, step = Adam(packed(weights).size, how), np.random.default_rng(how.seed), how.epochs * how.batches, 0
    best, history = (math.inf, weights), []
    for _ in range(how.epochs):
        loss = n = 0.0
        for k in rng.permutation(how.batches).tolist():
            one, counted, gradient = sums(stored.where(F.col("batch") == k), weights, network, how, step, length)
            if counted:
                weights = unpacked(adam.moved(packed(weights), gradient / counted, how.scale(step, steps)), weights)
            loss, n, step = loss + one, n + counted, step + 1
        history.append({"loss": loss / max(1.0, n)})
        if beside is not None:
            other, counted, _ = sums(beside, weights, network, how, None, length)
            history[-1]["held_out"] = other / max(1.0, counted)
            if history[-1]["held_out"] < best[0]:
                best = history[-1]["held_out"], weights
    return weights if beside is None or not math.isfinite(best[0]) else best[1], history


def scorer(weights: Weights, network: Network, length: int = TOKENS) -> Callable[[DataFrame], DataFrame]:
    """A scorer for detect_learned."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):
                some = batch.iloc[lo : lo + AT_ONCE]
                x, valid, _ = _dense(some, length)
                p = np.where(valid, sigmoid(forward(x, weights, network)[0]), 0.0)
                sizes = [len(at) for at in some["idx"]]
                yield pd.DataFrame({"norad_id": np.repeat(some["norad_id"].to_numpy(), sizes), "idx": np.concatenate(some["idx"].to_list()), "p": np.concatenate([p[k, at] for k, at in enumerate(some["position"])])})

    return lambda tokens: windows(tokens).mapInPandas(each, "norad_id long, idx long, p double")


# The trained detector


@dataclass(frozen=True)
class Bundle:
    """What a trained detector needs: network, weights, the scaler of the train split, thresholds, and how it was trained."""

    network: Network
    weights: Weights
    scaler: dict
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    training: dict = field(default_factory=dict)

    def detect(self, series: DataFrame) -> DataFrame:
        return detect_learned(series, scaler_of(series.sparkSession, self.scaler), scorer(self.weights, self.network), self.thresholds, self.default)

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        np.savez(f"{folder}/weights.npz", **self.weights)
        said = {"kind": "bilstm", "network": asdict(self.network), "scaler": self.scaler, "thresholds": self.thresholds, "default": self.default, "training": self.training}
        Path(f"{folder}/bundle.json").write_text(json.dumps(said, sort_keys=True, indent=2) + "\n")

    @classmethod
    def load(cls, folder: str) -> Bundle:
        said = json.loads(Path(f"{folder}/bundle.json").read_text())
        if said["kind"] != "bilstm":
            raise ValueError(f"a bundle of kind {said['kind']!r} is no recurrent network")
        network = Network(**said["network"])
        with np.load(f"{folder}/weights.npz") as found:
            weights = {k: found[k] for k in found.files}
        if {k: v.shape for k, v in weights.items()} != {k: v.shape for k, v in network.start(0).items()}:
            raise ValueError("the weights do not fit the network of the bundle")
        return cls(network, weights, said["scaler"], said["thresholds"], said["default"], said["training"])


def fit_detector(series: DataFrame, intervals: DataFrame, membership: DataFrame, network: Network | None = None, how: Training | None = None) -> Bundle:
    """A detector learned on the train split's objects; the epoch is chosen by those of val. intervals: norad_id, t1 of labelled gaps.

    The scaler and, unless how is given, the weight of a manoeuvre come from the train split alone.
    """
    network, encoded = network or Network(), kept(channels(series))
    split = lambda name: partition.members(encoded, membership.where(F.col("split") == name)).drop("split")
    quartiles = kept(class_quartiles(split("train")))

    def tokens(name: str) -> DataFrame:
        return token_windows(partition.token_targets(standardise(split(name), quartiles), intervals))

    how = how or Training(positive_weight=float(partition.positive_weight(tokens("train")).first()["weight"]))
    weights, history = train(windows(tokens("train")), network, how, windows(tokens("val")))
    return Bundle(network, weights, scaler_document(quartiles), training=asdict(how) | {"history": history})
