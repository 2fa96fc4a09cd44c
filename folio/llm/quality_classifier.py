"""Operator 5: quality classifier, a hashed word n-gram logistic regression trained with FTRL updates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, remainder, sample_ids, sample_rows, stored, table, whole_examples
from .textbatch import WordHashes, chunks, mix64, words

#: Weights; n-grams of words and of word shapes are hashed to them.
DIMENSIONS = 1 << 20
#: Training bound: labelled documents of each class, those with the smallest id hash, and their features together. Documents are whole.
TRAIN_ROWS, TRAIN_FEATURES = 6000, 8_000_000
EPOCHS = 5
THRESHOLD = 0.3
_U = np.uint64
_SHAPE = [(re.compile(r"[a-zà-öø-ÿœß]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-ÞŒ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^aA0])\1+"), r"\1")]


class ShapeHashes(dict):
    """Hash of a word's shape: runs of small letters, capitals and digits as one sign each."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        s = word.decode("utf-8", "replace")
        for pattern, to in _SHAPE:
            s = pattern.sub(to, s)
        h = self[word] = xxhash.xxh64_intdigest(s.encode()) ^ 0x5BD1E995
        return h


class Features:
    """Sparse vectors: counts of word and shape unigrams and bigrams, damped by log(1 + n) and scaled to length 1."""

    def __init__(self, remember: int = 50_000):
        self.words, self.shapes = WordHashes(remember), ShapeHashes(remember)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ws = words(text)
        if not ws:
            return np.zeros(0, np.int64), np.zeros(0)
        h, s = self.words.of(ws), np.fromiter(map(self.shapes.__getitem__, ws), np.uint64, len(ws))
        with np.errstate(over="ignore"):
            pairs = mix64(h[:-1] * _U(3) + h[1:])
            pairs[h[:-1] == h[1:]] = _U(0x1234567)  # a word said twice in a row is one feature, whatever the word
            shapes = mix64(s[:-1] * _U(5) + s[1:])
        idx, n = np.unique((np.concatenate([h, pairs, s, shapes]) >> _U(20)) % _U(DIMENSIONS), return_counts=True)
        v = np.log1p(n)
        return idx.astype(np.int64), v / np.sqrt((v * v).sum())


def train_ftrl(examples, y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.02, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader (proximal, a learning rate for each coordinate)."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, val = examples[k]
            i, v = np.append(idx, DIMENSIONS), np.append(val, 0.1)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y[k]) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1].astype(np.float32), float(w[-1] * 0.1)


def learn_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights from labelled documents: of each class at most TRAIN_ROWS, and TRAIN_FEATURES features together. The vectors of their whole texts,
    made on executors, come to the driver in 32-bit arrays; the bias is moved to the shares of the classes among all labels.
    Conflicting labels of an id: the lower one; rows that repeat an id: one of them. Null labels, ids and texts teach nothing. No labels, or one class: weights 0 and that share.
    Columns of docs and labels besides these do not matter, whatever their names."""
    given = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    shares = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = sample_rows(docs.where("text IS NOT NULL"), sample_ids(given, "y", TRAIN_ROWS, "quality"), ["doc_id"], ["text"]).select("doc_id", "y", "text")

    def vectors(batches):
        features = Features()
        for b, part in chunks(batches):
            xs = [features.of(t) for t in part]
            arrays = [pa.array([i.astype(np.int32).tobytes() for i, _ in xs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in xs], pa.binary()), pa.array([len(i) for i, _ in xs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *arrays], names=["doc_id", "y", "idx", "val", "n"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in texts.columns[:2])
    rows = whole_examples(stored(in_arrow(texts, vectors, f"{kinds}, idx binary, val binary, n long"), "quality-examples"), "y", "n", TRAIN_FEATURES, "quality") if shares else []
    good = shares.get(1, 0)
    prior = np.log((good + 1) / (sum(shares.values()) - good + 1)) if shares else 0.0
    if len({r["y"] for r in rows}) < 2:
        return np.zeros(DIMENSIONS, np.float32), float(prior)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["idx"]), bytes(r["val"])))
    y = np.array([r["y"] == 1 for r in rows], float)
    w, bias = train_ftrl([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in rows], y)
    return w, float(bias + prior - np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score), or docs' columns in `keep` and score: the chance that the label is 1, a sparse dot product over the whole text.

    Null and wordless texts have no features and score 0: nothing speaks for them. Repeated rows are scored each, equal texts alike; very long texts are one vector
    like others; an empty table gives no rows. Further columns of docs do not matter, whatever their names. The weights travel once to each executor (DIMENSIONS 32-bit numbers, whatever the input).
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)
    cols = [F.col(f"`{c}`") for c in keep] if keep else [F.col(id_col).alias("doc_id")]
    rows = docs.select(F.struct(*cols).alias("row"), F.col(text_col).alias("text"))

    def scored(batches):
        features = Features()
        w, bias = weights.value
        for b, texts in chunks(batches):
            xs = [features.of(t) for t in texts]
            dots = np.array([w[i] @ v + bias if len(i) else -np.inf for i, v in xs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.maximum(dots, -700))) * np.isfinite(dots))], names=["row", "score"])

    out = in_arrow(rows, scored, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out if keep else out.select("row.doc_id", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = remainder(F.col("doc_id"), 5) != 0
    model = learn_quality(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return score_quality(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
