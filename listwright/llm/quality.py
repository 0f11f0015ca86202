"""Quality by votes of the nearest labelled documents (operator 3).

A document becomes a vector of terms: hashed byte trigrams of its whole text
and a few marks of its shape (how long, how many different words, how often a
word follows itself, how much is not letters). Term weights and a truncated
singular value decomposition, both taken from at most ``TRAIN_ROWS`` labelled
training rows, turn it into a latent-semantic vector of ``RANK`` numbers. The
labelled vectors are broadcast (``TRAIN_ROWS`` x ``RANK`` float32, 1.5 MB). For
every document, the cosines with all of them are computed exactly, in blocks,
and the ``NEIGHBOURS`` nearest vote with their similarity as weight. The share of
votes becomes a probability by a logistic curve, fitted to the votes that the
labelled rows get from one another.

Defined cases: a null text is an empty one; an empty text has marks of its shape
and is scored like any other; without labelled rows every score is 0.5; rows
that share a doc_id are scored one by one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import query, table
from listwright.llm.labelled import held_out, labelled_sample

TRAIN_ROWS = 6000  # labelled rows that the model learns from, at most
RANK = 64
NEIGHBOURS = 25
TRIGRAM_BINS = 2048
THRESHOLD = 0.3
SHARPNESS = 4  # votes weigh the similarity to this power
BLOCK_CHARS = 1_000_000

LEVELS = 12
SHAPES = 6
TERMS = TRIGRAM_BINS + SHAPES * LEVELS
SHAPE_WEIGHT = 0.5


def shape(text: str) -> list[float]:
    """Numbers from 0 to 1: length, different words, words that follow themselves, word length, symbols, capitals."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0, 0]
    follows = sum(map(str.__eq__, words, words[1:]))
    letters = len(text) - n
    alone = sum(1 for x in words if len(x) == 1)
    marks = sum(map(text.count, "#$%&*|@{}<>=+^~_"))
    return [
        min(1.0, np.log2(n + 1) / 14), len(set(words)) / n, follows / n,
        min(1.0, letters / n / 16), min(1.0, 4 * marks / max(1, letters)), alone / n,
    ]


def terms(texts: list[str]) -> np.ndarray:
    """Rows of term counts; one row depends on its text alone."""
    out = np.zeros((len(texts), TERMS), np.float32)
    data = [x.lower().encode("utf-8", "replace") for x in texts]
    start = 0
    while start < len(data):
        end, size = start, 0
        while end < len(data) and (end == start or size + len(data[end]) <= BLOCK_CHARS):
            size += len(data[end])
            end += 1
        flat = np.frombuffer(b"".join(data[start:end]), np.uint8).astype(np.uint32)
        lengths = np.array([len(x) for x in data[start:end]])
        if len(flat) >= 3:
            code = flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA77) ^ flat[2:] * np.uint32(0xC2B2AE3D)
            code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 11)
            row = np.repeat(np.arange(end - start), lengths)
            whole = row[:-2] == row[2:]
            found = np.bincount(row[:-2][whole] * TRIGRAM_BINS + code[whole], minlength=(end - start) * TRIGRAM_BINS)
            out[start:end, :TRIGRAM_BINS] = found.reshape(end - start, TRIGRAM_BINS)
        start = end
    levels = np.array([shape(x) for x in texts], np.float64).reshape(len(texts), SHAPES)
    at = np.minimum((levels * LEVELS).astype(int), LEVELS - 1) + np.arange(SHAPES) * LEVELS + TRIGRAM_BINS
    np.put_along_axis(out, at, 1, axis=1)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    prior: float
    curve: tuple[float, float] = (0.0, 1.0)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Log counts, weighted; trigrams and shape are scaled to fixed lengths, so long texts don't outweigh short ones."""
        x = np.log1p(counts) * self.weights
        grams, marks = x[:, :TRIGRAM_BINS], x[:, TRIGRAM_BINS:]
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        marks *= SHAPE_WEIGHT / np.log(2)
        return x

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = self.weighted(counts) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def share(self, near: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1, by cosines with all labelled rows."""
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        found = [self.share(self.latent(terms(texts[a : a + 512])) @ self.vectors.T) for a in range(0, len(texts), 512)]
        votes = log_odds(np.concatenate([*found, np.zeros(0)]))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * votes, -30, 30)))


def log_odds(share: np.ndarray) -> np.ndarray:
    held = np.clip(share, 0.01, 0.99)
    return np.log(held / (1 - held))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method; the slope stays positive, so more votes never lower a score."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - penalty * (w - [0, 1])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(2), slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.05))


def decompose(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The first right singular vectors, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((len(x), min(rank + 16, *x.shape)), np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank]).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from at most ``rows`` labelled training rows; their term counts are made on the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                found = terms(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(), "counts": [np.minimum(x, 65535).astype("<u2").tobytes() for x in found]})

    sample = labelled_sample(docs, labels, label, rows).mapInPandas(count, "doc_id long, label int, counts binary")
    found = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["counts"])))
    y = np.array([r["label"] for r in found], np.float64)
    if not found:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.stack([np.frombuffer(r["counts"], "<u2") for r in found]).astype(np.float32)
    spread = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    spread[TRIGRAM_BINS:] = 1
    model = QualityModel(spread, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()))
    model.basis = decompose(model.weighted(x), RANK)
    model.vectors = model.latent(x)
    if len(y) > 1:
        votes = []
        for a in range(0, len(y), 512):
            near = model.vectors[a : a + 512] @ model.vectors.T
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -1
            votes.append(model.share(near))
        model.curve = fit_curve(log_odds(np.concatenate(votes)), y)
    return model


def quality_score(model: QualityModel, text: str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    shared = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.score(texts.tolist()))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
