"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams, its leading parts and the word itself, so
a misspelling that no document showed shares most of its vector. A passage is the mean over its words, and a two-class
softmax on it gives its logit. A document is judged by its passages' logits: the highest, the means of the highest two
and three, the mean of all, and their number, weighed by a logistic unit fitted on the same documents; so one insult in a
long text counts, and so does a low but steady share of telling words.
"""

from __future__ import annotations

import re
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bound_batches, held_out
from skein.llm.labelled import fit_in_a_task, logistic
from skein.llm.near_text import mix

FIND = re.compile(r"\w+").findall
PASSAGE = 12
GRAMS, LEADING = (3, 4, 5), (6, 7, 8)
BITS = 21
BUCKETS = 1 << BITS
U, BASE = np.uint64, 0x9E3779B97F4A7C15
#: Buckets that fewer documents of the sample hold have no embedding: they could only be learned by heart.
LEAST = 5
#: A passage's mean is scaled by its usual number of words, so that one telling word can decide.
GAIN = float(PASSAGE)


def words_of(text: str) -> list[str]:
    """Lower-case words."""
    return FIND(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and buckets of all parts of the words: each in angle brackets as a whole, its character n-grams and its
    leading parts. Parts of one word keep their order."""
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U) + U(7)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(cp))
    powers = np.cumprod(np.append(U(1), np.full(int(size.max(initial=1)), BASE, dtype=U)), dtype=U)
    whole = np.add.reduceat(cp * powers[np.arange(len(cp)) - np.repeat(first, size)], first) if len(words) else np.zeros(0, U)
    parts = [(np.arange(len(words)), whole * U(BASE))]
    padded, h = np.append(cp, np.zeros(max(GRAMS), U)), np.zeros(len(cp), U)
    for n in range(1, max(GRAMS) + 1):
        h = h * U(BASE) + padded[n - 1 : n - 1 + len(cp)]
        if n in GRAMS:
            fits = left >= n
            parts.append((owner[fits], (h[fits] + U(n)) * U(BASE)))
    at, h = first, h[first] if len(words) else h
    for n in range(max(GRAMS) + 1, max(LEADING) + 1):
        long = left[at] >= n
        at, h = at[long], h[long] * U(BASE) + cp[at[long] + n - 1]
        if n in LEADING:
            parts.append((owner[at], (h + U(1000 + n)) * U(BASE)))
    numbers, hashes = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    return numbers, (mix(hashes) >> U(64 - BITS)).astype(np.int32)


def passage_starts(words: int) -> list[int]:
    """Where passages start; a last one of less than half the length joins the one before."""
    return list(range(0, max(1, words - PASSAGE // 2), PASSAGE)) if words else [0]


def passage_logits(values: np.ndarray, bias: float) -> np.ndarray:
    """One logit per passage of a document, from its words' values; without words the bias."""
    if not len(values):
        return np.array([bias])
    at = np.array(passage_starts(len(values)))
    return GAIN * np.add.reduceat(values, at) / np.diff(np.append(at, len(values))) + bias


def summary(logits: np.ndarray) -> list[float]:
    """What the last unit sees of a document's passage logits (at least one)."""
    top = np.sort(logits)[::-1]
    return [top[0], top[:2].mean(), top[:3].mean(), top.mean(), np.clip(top, -6, 6).mean(), np.log(len(top))]


class Model:
    """Scores texts; holds one number per embedded bucket (its embedding times the softmax weights), the bias and the last unit."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float, unit: tuple | None, constant: float = 0.0):
        self.at, self.weight, self.bias, self.unit, self.constant = at, weight, bias, unit, constant

    def open(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.m, self.words = model, {}
        self.weight = np.zeros(BUCKETS)
        self.weight[model.at] = model.weight

    def values(self, words: list[str]) -> None:
        """Put the values of new words into the cache, which starts anew when it is full; results never depend on it."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(new) > 500_000:
            self.words.clear()
            new = list(dict.fromkeys(words))
        if new:
            number, at = subwords(new)
            sums = np.bincount(number, self.weight[at], len(new)) / np.bincount(number, minlength=len(new))
            self.words.update(zip(new, sums.tolist(), strict=True))

    def logits(self, words: list[str]) -> np.ndarray:
        """One logit per passage of a text's words, which are in the cache."""
        each = np.fromiter(map(self.words.__getitem__, words), float, len(words))
        # A word repeated without pause counts once.
        each = each[np.fromiter(map(ne, words, [None, *words[:-1]]), bool, len(words))]
        return passage_logits(each, self.m.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.m.unit is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.m.constant)))
        out = []
        for lo in range(0, len(texts), 100):
            each = [words_of(t) for t in texts[lo : lo + 100]]
            self.values([w for ws in each for w in ws])
            out += [summary(self.logits(ws)) for ws in each]
        mean, scale, weights = self.m.unit
        z = ((np.array(out).reshape(-1, len(mean)) - mean) / scale) @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Sample:
    """Documents as numbers of their words, and words as numbers of their buckets; texts themselves are not kept."""

    def __init__(self):
        self.ids, self.grams, self.length, self.docs, self.ys = {}, [], [], [], []

    def add(self, texts, ys) -> None:
        for lo in range(0, len(texts), 100):
            each = [words_of(t) for t in texts[lo : lo + 100]]
            new = [w for w in dict.fromkeys(w for ws in each for w in ws) if w not in self.ids]
            if new:
                self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
                number, at = subwords(new)
                self.grams.append(at[np.argsort(number, kind="stable")])
                self.length += np.bincount(number, minlength=len(new)).tolist()
            for ws in each:
                row = np.fromiter(map(self.ids.__getitem__, ws), np.int32, len(ws))
                self.docs.append(row[np.diff(row, prepend=-1) != 0])
        self.ys += [int(y) for y in ys]


def fit(sample: Sample, shift: float = 0.0, folds: int = 2, seed: int = 7) -> Model:
    """Train on documents; shift is the log of the class ratio outside over inside the sample.

    The last unit is fitted on the logits that each document gets from embeddings learned without it. Without both classes
    the model is constant. The same documents in the same order give the same model.
    """
    docs, ys = sample.docs, sample.ys
    none = np.zeros(0, np.int32)
    if len(set(ys)) < 2:
        return Model(none, none.astype(float), 0.0, None, 4.0 * (2 * ys[0] - 1) if ys else 0.0)
    length = np.array(sample.length or [1])
    flat = np.concatenate(sample.grams) if sample.grams else none
    first = np.concatenate([[0], np.cumsum(length)])
    # Documents that hold each bucket.
    held = np.zeros(BUCKETS, np.int32)
    for d in docs:
        if len(d):
            held[np.unique(np.concatenate([flat[first[w] : first[w + 1]] for w in np.unique(d)]))] += 1
    least = min(LEAST, max(1, len(docs) // 100))
    live = np.flatnonzero(held >= least).astype(np.int32)
    place = np.full(BUCKETS, len(live), np.int32)
    place[live] = np.arange(len(live))
    flat = place[flat]
    del held, place
    y, everyone = np.array(ys, dtype=float), np.arange(len(docs))
    # Folds by rank inside each class.
    fold = np.zeros(len(docs), dtype=int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % folds
    seen = np.zeros((len(docs), 6))
    for k in range(folds):
        weight, bias = learn(docs, y, everyone[fold != k], flat, first, length, len(live), seed + 1 + k)
        words = word_values(weight, flat, length, first)
        for i in np.flatnonzero(fold == k):
            seen[i] = summary(passage_logits(words[docs[i]], bias))
    weight, bias = learn(docs, y, everyone, flat, first, length, len(live), seed)
    return Model(live, weight[:-1], bias, logistic(seen, y, np.where(y > 0, np.exp(shift), 1.0)))


def word_values(weight: np.ndarray, flat: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight[flat], first[:-1]) / length if len(flat) else np.zeros(1)


def learn(docs: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, flat: np.ndarray, first: np.ndarray, length: np.ndarray, live: int, seed: int, dim: int = 8, passes: int = 20_000, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Embeddings and softmax of the chosen documents, trained jointly: one number per embedded bucket, and the bias."""
    rng = np.random.default_rng(seed)
    # The last row stands for all buckets without an embedding and stays 0.
    table = np.vstack([rng.normal(0, 0.1, (live, dim)), np.zeros((1, dim))]).astype(np.float32)
    # A passage without telling words is clean; so the usual words need not carry that.
    out, bias = rng.normal(0, 1, dim).astype(np.float32), -4.0
    table_sq, out_sq, bias_sq = np.full((live + 1, 1), 1e-6, np.float32), np.full(dim, 1e-6), 1e-6
    full = np.array([i for i in chosen if len(docs[i])], dtype=int)
    # Few documents are seen more often, so that any sample gives about as many steps.
    epochs = int(np.clip(passes / max(1, len(full)), 5, 20))
    for _ in range(epochs):
        order = rng.permutation(full)
        for lo in range(0, len(order), 48):
            batch = order[lo : lo + 48]
            tokens = np.concatenate([docs[i] for i in batch])
            starts, owner, base = [], [], 0
            for k, i in enumerate(batch):
                own = passage_starts(len(docs[i]))
                starts += [base + s for s in own]
                owner += [k] * len(own)
                base += len(docs[i])
            starts, owner = np.array(starts), np.array(owner)
            sizes = np.diff(np.append(starts, len(tokens)))
            used, at = np.unique(tokens, return_inverse=True)
            n = length[used]
            ends = np.cumsum(n)
            pick = flat[np.repeat(first[used] - (ends - n), n) + np.arange(ends[-1])]
            # Means of embeddings times the softmax weights are means of the products, one number per bucket.
            product = (table @ out).astype(np.float64)
            values = np.add.reduceat(product[pick], ends - n) / n
            z = GAIN * np.add.reduceat(values[at], starts) / sizes + bias
            # The most toxic passages speak for a document.
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            many = np.diff(np.append(head, len(z)))
            soft = np.exp(z - np.repeat(np.maximum.reduceat(z, head), many))
            soft /= np.repeat(np.add.reduceat(soft, head), many)
            g = soft * (1 / (1 + np.exp(-z)) - y[batch][owner]) / len(batch)
            g_bias = g.sum()
            g_words = np.repeat(GAIN * g / sizes, sizes)
            sums = np.bincount(at, g_words, len(used)) / n
            # Every embedding moves along the softmax weights, so one number per bucket is its gradient.
            g_bucket = np.bincount(pick, np.repeat(sums, n), len(table)).astype(np.float32)
            g_bucket[-1] = 0
            g_out = g_bucket @ table
            hit = np.flatnonzero(g_bucket)
            move = g_bucket[hit, None] * out
            table_sq[hit] += (move**2).mean(1, keepdims=True)
            table[hit] -= rate * move / np.sqrt(table_sq[hit])
            out_sq += g_out**2
            bias_sq += g_bias**2
            out -= (0.1 * g_out / np.sqrt(out_sq)).astype(np.float32)
            bias -= 0.1 * g_bias / np.sqrt(bias_sq)
    return (table @ out).astype(np.float64), float(bias)


def score_column(spark, text: Column, model) -> Column:
    """Scores of whole texts by a model that open()s to a scorer; its size does not depend on the corpus."""
    shared = spark.sparkContext.broadcast(model)
    opened = []

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not opened:
            opened.append(shared.value.open())
        return pd.Series(opened[0].scores(list(texts)), dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 2000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted in place of columns of those names.

    The model is fitted on at most `most` labelled documents of each class that are not held out, and scores every whole
    text; null texts count as empty ones. An empty table of labels gives 0.5 throughout.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    model = fit_in_a_task(docs, labels, "toxic", most, Sample, fit, id_col, text_col)
    scored = docs.withColumn("score", score_column(spark, F.coalesce(F.col(text_col), F.lit("")), model))
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
