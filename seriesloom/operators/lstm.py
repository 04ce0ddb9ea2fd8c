"""A one-layer LSTM classifier on whole sequences, trained on full batches.

Each epoch is one Spark job: partitions of sequences return the sums of their gradients, which are
added up and applied by AdamW on the driver.  Weights are small; sequences never leave executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(inputs: int, hidden: int, classes: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng, r = np.random.default_rng(seed), 1 / np.sqrt(hidden)
    shapes = {"wx": (inputs, 4 * hidden), "wh": (hidden, 4 * hidden), "b": (4 * hidden,), "wo": (hidden, classes), "bo": (classes,)}
    return {k: rng.uniform(-r, r, s).astype(np.float32) for k, s in shapes.items()}


def forward(w: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Class scores of (batch, steps, inputs), and what the gradient needs; gates are i, f, g, o."""
    h = c = np.zeros((len(x), w["wh"].shape[0]), x.dtype)
    kept = []
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w["wx"] + h @ w["wh"] + w["b"], 4, axis=1)
        i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
        before, c = (h, c), f * c + i * g
        h = o * np.tanh(c)
        kept.append((*before, i, f, g, o, c))
    return h @ w["wo"] + w["bo"], [*kept, h]


def gradient(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sums over the batch of the cross-entropy and of its gradient."""
    scores, kept = forward(w, x)
    scores = scores - scores.max(1, keepdims=True)
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).sum())
    p[np.arange(len(y)), y] -= 1
    out = {k: np.zeros_like(v) for k, v in w.items()}
    out["wo"], out["bo"] = kept[-1].T @ p, p.sum(0)
    dh, dc = p @ w["wo"].T, 0.0
    for t in range(x.shape[1] - 1, -1, -1):
        h0, c0, i, f, g, o, c = kept[t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
        out["wx"] += x[:, t].T @ dz
        out["wh"] += h0.T @ dz
        out["b"] += dz.sum(0)
        dh, dc = dz @ w["wh"].T, dc * f
    return loss, out


@dataclass
class Lstm:
    weights: dict[str, np.ndarray]
    losses: list[float]

    @classmethod
    def fit(cls, train: DataFrame, classes: int, hidden: int = 32, epochs: int = 30, rate: float = 1e-3, decay: float = 0.01, seed: int = 11) -> Lstm:
        """`train` has sequence ARRAY<ARRAY<DOUBLE>> (all of one shape) and label_idx."""
        first = train.select(F.size(F.element_at("sequence", 1)).alias("inputs"), F.count(F.lit(1)).over(_all()).alias("n")).first()
        w = initial(first["inputs"], hidden, classes, seed)
        m, v, losses = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, []
        m, v = m
        rows = train.select("sequence", "label_idx").persist()
        for epoch in range(1, epochs + 1):

            def sums(parts: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
                for part in parts:
                    loss, g = gradient(w, tensor(part["sequence"]), part["label_idx"].to_numpy(np.int64))
                    yield pd.DataFrame([(loss, np.concatenate([g[k].ravel() for k in w]).tolist())], columns=["loss", "g"])

            loss, flat = 0.0, np.zeros(sum(x.size for x in w.values()))
            for r in rows.mapInPandas(sums, "loss double, g array<double>").toLocalIterator():
                loss, flat = loss + r["loss"], flat + np.array(r["g"])
            losses.append(loss / first["n"])
            cut = np.split(flat / first["n"], np.cumsum([x.size for x in w.values()])[:-1])
            for k, g in zip(list(w), cut, strict=True):
                g = g.reshape(w[k].shape)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                change = m[k] / (1 - 0.9**epoch) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
                w[k] = (w[k] * (1 - rate * decay) - rate * change).astype(np.float32)
        rows.unpersist()
        return cls(w, losses)

    def predict(self, seqs: DataFrame) -> DataFrame:
        """`seqs` with pred_idx, the class of the largest score, the lowest on ties."""
        w = self.weights

        @F.pandas_udf("int")
        def best(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(forward(w, tensor(part))[0].argmax(1).astype(np.int32))

        return seqs.withColumn("pred_idx", best("sequence"))


def tensor(column: pd.Series) -> np.ndarray:
    """(rows, steps, inputs) in single precision."""
    return np.array([np.stack(list(s)) for s in column], np.float32)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()
