"""Text quality: supervised subword embeddings.

A document is the mean of its words' vectors, a word the mean of learned hashed vectors of
itself and its character n-grams; softmax over two classes on top, all trained by stochastic
gradient descent in numpy on a bounded sample of labelled texts. Scoring reads every whole
text, from the text alone, and holds one row for each distinct word; words of over 200
characters, as in text without spaces, are read as consecutive words.

A null or empty text has no words and gets the score of the bias, which is learned from the
share of good texts. Repeated rows get equal scores; further columns are ignored. Without
labels of both classes every text gets ``without_labels``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.subwords import BUCKETS, Spans, WordRows, csr, labelled_sample, pieces, word_vectors

DIM = 16
EPOCHS = 6
RATE = 0.5
SAMPLE = 2500  # labelled texts of each class, at most
SAMPLE_CHARS = 20_000
LONG_CHARS = 1_000_000  # of longer texts of each class, together


@dataclass
class Model:
    table: np.ndarray  # buckets x DIM
    output: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2


AGAIN = "<again>"


def words_of(text: str | None) -> list[str]:
    """Words between white space; one that repeats the word before it becomes AGAIN, so that
    any word said over and over is the same feature. Long ones go on in pieces."""
    words = (text or "").lower().split()
    return pieces([AGAIN if word == last else word for word, last in zip(words, ["", *words])])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(texts: list[tuple[str, int]], prior: float | None = None, seed: int = 7) -> Model | None:
    """Fit on (text, label) pairs; ``prior`` is the share of label 1 outside the sample.

    Each class weighs as much as it does there.
    """
    labels = np.array([y for _, y in texts])
    if not len(texts) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    model = Model(
        rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
        np.zeros((DIM, 2), np.float32),
        np.zeros(2, np.float32),
    )
    share = labels.mean()
    prior = share if prior is None else min(max(prior, 0.01), 0.99)
    weight = {1: prior / share, 0: (1 - prior) / (1 - share)}
    rows = {}
    seen = []
    for text, y in texts:
        words = words_of(text)
        ids = np.fromiter((rows.setdefault(w, len(rows)) for w in words), np.int64, len(words))
        seen.append((*np.unique(ids, return_counts=True), y))
    buckets = Spans(list(rows))
    steps, step = EPOCHS * len(seen), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(seen)):
            ids, counts, y = seen[at]
            rate = RATE * (1 - step / steps) * weight[y]
            step += 1
            if len(ids):
                spans = [buckets[i] for i in ids]
                lengths = np.array([len(s) for s in spans])
                used, back = np.unique(np.concatenate(spans), return_inverse=True)
                share_of = np.repeat(counts / counts.sum() / lengths, lengths)
                share_of = np.bincount(back, share_of).astype(np.float32)
                hidden = share_of @ model.table[used]
            else:
                hidden = np.zeros(DIM, np.float32)
            error = _softmax(hidden @ model.output + model.bias)
            error[y] -= 1
            slope = model.output @ error
            model.output -= rate * np.outer(hidden, error)
            model.bias -= 0.1 * rate * error
            if len(ids):
                model.table[used] -= rate * np.minimum(share_of * 50, 1)[:, None] * slope
    return model


class Scorer:
    """Scores of label 1; one per Python worker and partition."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordRows(self._margins, 1)

    def _margins(self, words: list[str]) -> np.ndarray:
        vectors = word_vectors(self.model.table, *csr(words))
        return vectors @ (self.model.output[:, 1:] - self.model.output[:, :1])

    def score(self, text: str | None) -> float:
        words = words_of(text)
        margin = float(self.model.bias[1] - self.model.bias[0])
        if words:
            rows = self.words.rows(words)
            margin += float(self.words.table[rows, 0].mean(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = SAMPLE) -> Model | None:
    """A model from the labelled rows that ``may_learn`` admits (a bounded sample of them)."""
    sample = labelled_sample(docs, labels, "quality", may_learn, per_class, SAMPLE_CHARS, LONG_CHARS)
    prior = labels.where(may_learn).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return train(sample, prior)


def score(docs: DataFrame, model: Model | None, without_labels: float = 1.0) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(float(without_labels)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [scorer.score(x) for x in batch["text"]]})

    return docs.mapInPandas(scored, "doc_id long, score double")
