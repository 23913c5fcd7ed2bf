"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held_out


def fit_in_a_task(docs: DataFrame, labels: DataFrame, label: str, most: int, gather, fit, id_col: str = "doc_id", text_col: str = "text"):
    """The model that fit(gathered, shift) gives of a sample of labelled documents; only it comes to the driver.

    At most `most` documents of each label, those whose hashed ids come first, so the bound is on labelled rows alone and
    a larger corpus gives as many. Held-out rows, null ids and null labels never enter; a repeated id enters once, with
    its greatest label and its least text. One task sees the sample in the order of ids, batch by batch: gather() has
    add(texts, ys) and keeps what the fit needs of them. shift is the log of how much rarer label 1 is among all labelled
    rows than in the sample. A lost executor means the same fit again.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    # Bounded: 2 * most ids.
    chosen = F.broadcast(few[0].unionByName(few[1]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def train(frames):
        seen, ones, zeros = gather(), 0, 0
        for f in frames:
            ys = f["label"].astype(int).tolist()
            seen.add(f["text"].tolist(), ys)
            ones += sum(ys)
            zeros += len(ys) - sum(ys)
        shift = math.log(counts[1] / counts[0]) - math.log(ones / zeros) if ones and zeros else 0.0
        yield pd.DataFrame({"model": [pickle.dumps(fit(seen, shift))]})

    model = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "label").mapInPandas(train, "model binary").collect()
    # An empty table may have no partition at all.
    return pickle.loads(model[0]["model"]) if model else fit(gather(), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.1, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the intercept last) of the logistic fit of y on the columns of x, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, hold = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ a + hold
        w = w - np.clip(np.linalg.solve(hess, a.T @ (weights * (p - y)) + ridge * w), -2, 2)
    return mean, scale, w


def platt(logits, ys, weights, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of ys on logits, by Newton steps with a small ridge."""
    import numpy as np

    x, y, a, b = np.asarray(logits, float), np.asarray(ys, float), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weights * (p - y), weights * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 1e-2 * (a - 1), g.sum() + 1e-2 * b])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)
