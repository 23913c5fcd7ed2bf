"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from the shape of its characters, words and lines; gated
attention (a tanh branch times a sigmoid branch) weighs the passages, and a logistic unit scores the weighted passage
representation. All weights are learned from document labels alone, in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bound_batches, held_out
from skein.llm.labelled import fit_in_a_task, platt

PASSAGE = 64
#: Character classes: ASCII one by one (without letters, digits, controls), then groups.
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, SPACE, LINE, OTHER, CONTROL = range(len(SYMBOLS), len(SYMBOLS) + 7)
CLASSES = len(SYMBOLS) + 7


def _table() -> np.ndarray:
    out = np.full(0x250, OTHER, dtype=np.int64)
    for c in range(0x250):
        ch = chr(c)
        if ch in SYMBOLS:
            out[c] = SYMBOLS.index(ch)
        elif ch == "\n":
            out[c] = LINE
        elif ch in "\t\x0b\x0c\r ":
            out[c] = SPACE
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch.isupper():
            out[c] = UPPER
        elif ch.islower():
            out[c] = LOWER
        elif c < 32:
            out[c] = CONTROL
    return out


TABLE = _table()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
WIDTH = CLASSES + 17


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """Distinct keys of each group."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g[new], minlength=groups)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of texts, and the number of passages of each text (at least one)."""
    raw = "\n".join(texts) + "\n"
    cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = TABLE[np.minimum(cp, 0x24F)]
    doc_of_char = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    gap = cls >= SPACE
    gap &= cls <= LINE
    start = ~gap
    start[1:] &= gap[:-1] | (doc_of_char[1:] != doc_of_char[:-1])
    first = np.flatnonzero(start)
    words = np.bincount(doc_of_char[first], minlength=len(texts))
    bags = np.maximum(1, (words + PASSAGE // 2) // PASSAGE)
    ends = np.cumsum(bags)
    n = int(ends[-1]) if len(texts) else 0
    rank = np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words)
    word_doc = doc_of_char[first]
    passage = (ends - bags)[word_doc] + np.minimum(rank // PASSAGE, bags[word_doc] - 1)
    # Characters before the first word of a document belong to its first passage.
    of_word = np.cumsum(start) - 1
    lead = (of_word < 0) | (word_doc[np.maximum(of_word, 0)] != doc_of_char) if len(first) else np.ones(len(cp), dtype=bool)
    of_char = (ends - bags)[doc_of_char]
    if len(first):
        of_char[~lead] = passage[of_word[~lead]]
    shape = np.bincount(of_char * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    chars = np.maximum(shape.sum(1), 1)
    out = np.zeros((n, WIDTH))
    out[:, :CLASSES] = np.sqrt(shape / chars[:, None])
    if len(first):
        inside = ~gap
        word_of = of_word[inside]
        at = np.flatnonzero(inside) - first[word_of]
        length = np.bincount(word_of, minlength=len(first))
        hashed = np.zeros(len(first), dtype=np.uint64)
        heads = np.flatnonzero(np.diff(word_of, prepend=-1))
        hashed[:] = np.add.reduceat((cp[inside].astype(np.uint64) + np.uint64(7)) * POWERS[at % 64], heads)
        count = np.bincount(passage, minlength=n)
        per = np.maximum(count, 1)
        mean = lambda x: np.bincount(passage, x, n) / per
        letters = np.add.reduceat((cls[inside] == UPPER).astype(np.int64), heads)
        marks = np.add.reduceat((cls[inside] < len(SYMBOLS)).astype(np.int64), heads)
        size = mean(length)
        same = np.zeros(len(first))
        same[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
        again = np.zeros(len(first))
        if len(first) > 2:
            again[2:] = (hashed[2:] == hashed[:-2]) & (passage[2:] == passage[:-2])
        extra = [
            size / 10,
            np.sqrt(np.maximum(0, mean(length**2.0) - size**2)) / 10,
            _distinct(passage, hashed, n) / per,
            mean(same),
            mean(again),
            mean((letters == length).astype(float)),
            mean((letters > 0).astype(float)),
            mean((marks > 0).astype(float)),
            mean((marks > 1).astype(float)),
            mean((marks == length).astype(float)),
            mean((length <= 2).astype(float)),
            mean((length >= 14).astype(float)),
            np.log1p(count) / 5,
            (shape[:, LINE] / per),
        ]
        whole = np.maximum(words, 1)
        context = [np.log1p(words) / 8, _distinct(word_doc, hashed, len(texts)) / whole, np.log1p(words / np.maximum(1, np.bincount(doc_of_char, cls == LINE, len(texts)))) / 5]
        out[:, CLASSES:] = np.stack(extra + [np.repeat(c, bags) for c in context], axis=1)
    return out, bags


class Model:
    """Learned weights: encoder, gated attention, scorer; standardisation and calibration. Its size is fixed."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, slope: float = 1.0, intercept: float = 0.0):
        self.w, self.mean, self.scale, self.slope, self.intercept = weights, mean, scale, slope, intercept

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w, head = self.w, np.cumsum(bags) - bags
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        a = (t * s) @ w["a"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, head), bags))
        a /= np.repeat(np.add.reduceat(a, head), bags)
        z = np.add.reduceat(a[:, None] * h, head, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ w["c"] + w["b"]}

    def logits(self, texts: list[str], block: int = 200) -> np.ndarray:
        out = [np.zeros(0)]
        for lo in range(0, len(texts), block):
            x, bags = encode(texts[lo : lo + block])
            out.append(self.forward((x - self.mean) / self.scale, bags)["logit"])
        return np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.intercept, -60, 60)))


class Sample:
    """Features of the passages of documents; the texts themselves are not kept."""

    def __init__(self):
        self.x, self.bags, self.ys = [], [], []

    def add(self, texts: list[str], ys: list[int]) -> None:
        for lo in range(0, len(texts), 200):
            x, bags = encode(texts[lo : lo + 200])
            self.x.append(x)
            self.bags.append(bags)
        self.ys += ys


def fit(sample: Sample, shift: float = 0.0, hidden: int = 24, gate: int = 12, passes: int = 120_000, rate: float = 3e-3, seed: int = 11) -> Model:
    """Train on documents with Adam; without both classes the model is constant. Deterministic."""
    rng, ys = np.random.default_rng(seed), sample.ys
    shapes = {"E": (WIDTH, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "eb" else np.zeros(s) for k, s in shapes.items()}
    if len(set(ys)) < 2:
        return Model({k: v * 0 for k, v in w.items()}, np.zeros(WIDTH), np.ones(WIDTH), 1.0, 4.0 * (2 * ys[0] - 1) if ys else 0.0)
    x, bags = np.concatenate(sample.x), np.concatenate(sample.bags)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    first, y = np.cumsum(bags) - bags, np.array(ys, dtype=float)
    model = Model(w, mean, scale)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step, epochs = 0, int(np.clip(passes / len(ys), 15, 120))
    for epoch in range(epochs):
        order = rng.permutation(len(ys))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            n = bags[batch]
            rows = np.repeat(first[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xb = x[rows]
            f = model.forward(xb, n)
            g = (1 / (1 + np.exp(-f["logit"])) - y[batch]) / len(batch)
            grad = {"c": f["z"].T @ g, "b": np.array([g.sum()])}
            gz = np.repeat(g[:, None] * w["c"], n, axis=0)
            dot = (gz * f["h"]).sum(1)
            head = np.cumsum(n) - n
            ga = f["a"] * (dot - np.repeat(np.add.reduceat(f["a"] * dot, head), n))
            grad["a"] = (f["t"] * f["s"]).T @ ga
            gate_g = ga[:, None] * w["a"]
            gt, gs = gate_g * f["s"] * (1 - f["t"] ** 2), gate_g * f["t"] * f["s"] * (1 - f["s"])
            grad["V"], grad["U"] = f["h"].T @ gt, f["h"].T @ gs
            gh = (f["a"][:, None] * gz + gt @ w["V"].T + gs @ w["U"].T) * (1 - f["h"] ** 2)
            grad["E"], grad["e"] = xb.T @ gh, gh.sum(0)
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in grad.items():
                d = d + 1e-4 * w[k]
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] -= pace * m[k] / (np.sqrt(v[k]) + 1e-8)
    logits = np.concatenate([model.forward(x[first[i] : first[i] + bags[i]], bags[i : i + 1])["logit"] for i in range(len(ys))])
    model.slope, model.intercept = platt(logits, y, np.where(y > 0, np.exp(shift), 1.0))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 2000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted in place of columns of those names.

    The model is fitted on at most `most` labelled documents of each class that are not held out, and scores every whole
    text; null texts count as empty ones, a bag of one empty passage. An empty table of labels gives 0.5 throughout.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(fit_in_a_task(docs, labels, "quality", most, Sample, fit, id_col, text_col))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(texts)), dtype="float64")

    scored = docs.withColumn("score", score(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
