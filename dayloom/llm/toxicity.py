"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Every sentence has a logistic score from hashed words
and word beginnings, and the document's score is their noisy-or, 1 - prod(1 - p). Only
documents have labels; the gradient of the noisy-or decides which sentences they fall
on. Training takes a bounded sample of labelled rows, drawn by hash; scoring is one
narrow pass over whole texts, and the same sentence scores locate offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import saved

#: Bounds of the training sample: rows of either label, and characters in all.
TOXIC_ROWS, CLEAN_ROWS, CHARACTERS = 3000, 6000, 24_000_000
#: Hashed features, the least number of training documents a feature must be in.
FEATURES, LEAST_DOCS = 1 << 18, 3
#: A sentence ends at these marks, or after this many words.
TOKENS, LONGEST = re.compile(r"\w+|[.!?\n]+"), 40
#: Beginnings of words that are features.
BEGINNINGS = (4, 5)
#: A feature's weight is never negative, and it has one only if its share of the toxic
#: training documents is this many times its share of the clean ones.
RATIO = 3.0
STEPS, RATE, SPARSE = 200, 0.2, 4e-5
REMEMBERED = 1 << 17


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings."""
    names = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """``(start, end, lower-case words)`` of every sentence that has words."""
    words, start, end = [], 0, 0
    for m in TOKENS.finditer(text):
        if m[0][0] in ".!?\n":
            if words:
                yield start, m.end(), words
                words = []
            continue
        if not words:
            start = m.start()
        words.append(m[0].lower())
        end = m.end()
        if len(words) == LONGEST:
            yield start, end, words
            words = []
    if words:
        yield start, end, words


@dataclass
class Model:
    """Weights of the hashed features and the bias of every sentence; an empty document
    counts as one sentence without words."""

    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(**state)

    def word(self, word: str) -> float:
        value = float(sum(self.weights[i] for i in features(word)))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) < 100:
            self.known[word] = value
        return value

    def chances(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + sums, -30, 30)))

    def score(self, text: str) -> float:
        """Noisy-or over the text's sentences."""
        known, sums, total, n = self.known, [], 0.0, 0
        for token in TOKENS.findall(text.lower()):
            if token[0] in ".!?\n":
                if n:
                    sums.append(total)
                    total, n = 0.0, 0
                continue
            value = known.get(token)
            total += self.word(token) if value is None else value
            n += 1
            if n == LONGEST:
                sums.append(total)
                total, n = 0.0, 0
        if n or not sums:
            sums.append(total)
        z = np.clip(self.bias + np.array(sums), -30, 30)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fit(sizes: np.ndarray, at: np.ndarray, of: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Gradient steps (Adam) on the weighted log-likelihood of the noisy-or, with an L1
    penalty and weights of zero or more: words can accuse a sentence, none can excuse it.

    ``sizes`` has the sentences of every document; feature ``at[i]`` is in sentence
    ``of[i]``, counted through all documents.
    """
    toxic = float(weights[labels == 1].sum() / weights.sum()) if len(labels) else 0.0
    share = min(max(toxic, 1e-3), 0.999)
    bias = float(np.log(np.expm1(-np.log1p(-share) / (sizes.mean() if len(sizes) else 1))))
    full = np.zeros(FEATURES, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(full, bias)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    names, at = np.unique(at, return_inverse=True)
    w = np.zeros(len(names))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    positive = labels[doc] == 1
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(of, weights=w[at], minlength=len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        chance = -np.expm1(-np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(sizes)))
        chance = np.clip(chance, 1e-9, 1)[doc]
        g = np.where(positive, -p * (1 - chance) / chance, p) * weights[doc] / weights.sum()
        grad = np.append(np.bincount(at, weights=g[of], minlength=len(names)) + SPARSE, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w = np.maximum(w - move[:-1], 0)
        bias -= move[-1]
    full[names] = w
    return Model(full, float(bias))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits the model on a bounded sample of ``labels`` joined with ``docs``.

    The sample holds at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` keys, first by md5, and
    about ``CHARACTERS`` characters. A text of more than a hundredth of that is not learned
    from (it is scored like any other), so that none takes the place of all others. Its size is fixed, so its keys are broadcast to the
    texts; only features that lean to the toxic side come to the driver. Clean rows are weighted back to their share
    of all labels. Null keys and labels are left out; a key with several labels is
    toxic if one says so; without both labels the scores are one constant.
    """
    known = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_key").isNotNull() & F.col("_label").isin(0, 1))
        .groupBy("_key").agg(F.max("_label").alias("_label"))
        .withColumn("_order", F.md5(F.col("_key").cast("string")))
    )
    totals = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    parts = [
        known.filter(F.col("_label") == x).orderBy("_order", "_key").limit(n).collect()
        for x, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    spark = docs.sparkSession
    drawn = spark.createDataFrame([tuple(r) for p in parts for r in p], known.schema)
    found = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(
        F.broadcast(drawn), "_key"
    ).filter(F.length("_text") <= CHARACTERS // 100)

    def drawn_features(batches):
        for b in batches:
            rows = [sorted({i for _, _, words in sentences(t) for w in words for i in features(w)}) for t in b["_text"]]
            yield pd.DataFrame({"_features": rows}).assign(**{c: b[c].to_numpy() for c in ("_label", "_order")}, _chars=b["_text"].str.len())

    so_far = F.sum("_chars").over(Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))  # a bounded table
    sample = saved(
        found.mapInPandas(drawn_features, "_features array<int>, _label int, _order string, _chars long"), "sample"
    )
    last = sample.select("_order", so_far.alias("_sum")).filter(F.col("_sum") <= CHARACTERS).agg(F.max("_order")).first()[0]
    sample = sample.filter(F.col("_order") <= F.lit(last or ""))
    n = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    often = sample.select(F.explode("_features").alias("_feature"), "_label").groupBy("_feature").agg(
        F.sum(F.col("_label")).alias("_toxic"), F.sum(1 - F.col("_label")).alias("_clean")
    )
    accused = (F.col("_toxic") + 0.5) / (n.get(1, 0) + 1) >= RATIO * (F.col("_clean") + 0.5) / (n.get(0, 0) + 1)
    # at most FEATURES numbers
    kept = frozenset(r[0] for r in often.filter((F.col("_toxic") >= LEAST_DOCS) & accused).select("_feature").collect())

    def bags(batches):
        for b in batches:
            rows = []
            for t in b["_text"]:
                size, at, of = 0, [], []
                for _, _, words in sentences(t):
                    new = [i for w in words for i in features(w) if i in kept]
                    at += new
                    of += [size] * len(new)
                    size += 1
                rows.append((max(1, size), np.array(at, np.int32), np.array(of, np.int32)))
            out = pd.DataFrame(rows, columns=["_size", "_at", "_of"])
            yield out.assign(_label=b["_label"].to_numpy(), _order=b["_order"].to_numpy())

    rows = (
        found.filter(F.col("_order") <= F.lit(last or ""))
        .mapInPandas(bags, "_size int, _at array<int>, _of array<int>, _label int, _order string").toPandas()
        .sort_values(["_order", "_size"], kind="stable")
    )
    y, sizes = rows["_label"].to_numpy(np.int64), rows["_size"].to_numpy(np.int64)
    ratio = {x: totals.get(x, 0) / max(1, int((y == x).sum())) for x in (0, 1)}
    before = np.cumsum(np.r_[0, sizes])[:-1]
    none = [np.empty(0, np.int64)]
    at = np.concatenate([*map(np.asarray, rows["_at"]), *none]).astype(np.int64)
    of = np.concatenate([*(np.asarray(o, np.int64) + start for o, start in zip(rows["_of"], before)), *none])
    return fit(sizes, at, of.astype(np.int64), y, np.array([ratio[x] for x in y], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from 0.5 on) for every row.

    A null text is empty and scored as such; repeated rows and null keys are kept.
    Columns named ``score`` or ``predicted`` are replaced.
    """
    kept = docs.drop("score", "predicted")

    def scored(batches):
        for b in batches:
            s = np.array([model.score(t or "") for t in b[text]], float)
            yield b.assign(score=s, predicted=(s >= 0.5).astype(np.int32))

    kinds = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInPandas(scored, f"{kinds}, score double, predicted int")


def locate(
    docs: DataFrame, model: Model, least: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Offending sentences ``(key, start, end, sentence, chance)`` with chance ``least`` or more."""

    def found(batches):
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                for start, end, words in sentences(t or ""):
                    chance = float(model.chances(np.array([sum(map(model.word, words))]))[0])
                    if chance >= least:
                        rows.append((k, start, end, t[start:end], chance))
            yield pd.DataFrame(rows, columns=[key, "start", "end", "sentence", "chance"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(
        found, f"`{key}` {kind}, start long, end long, sentence string, chance double"
    )


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether crc32 of the key as text leaves no remainder; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0
