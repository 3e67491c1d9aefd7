"""Operator 4: toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed
terms i of a text: linear weights as in any linear model, plus factors whose
products reward pairs of terms (an insult together with a group mention) that
neither term's weight can express. Terms are lower-cased words and their stems
(first four and five letters). The pairwise sum costs one pass over the terms:
(|sum v|^2 - sum |v|^2) / 2.

Training: at most ``TRAIN_ROWS`` labelled documents (chosen by hash within each
label; never held-out ones), in numpy by AdaGrad. The model is a fixed-size
table of ``BUCKETS`` weights and factors, sent to the workers. Everything else
covers all documents.

Defined results: null and empty texts have no terms and get the bias alone
(score in (0, 1)); repeated label rows count as one (toxic if any says so);
repeated documents are scored each on their own; without labels every score is
0.5 or less; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import crc_mod, id_and_text, map_blocks, read_table

BUCKETS = 1 << 20
FACTORS = 4
TRAIN_ROWS = 6000
#: Distinct words kept by a worker before it starts anew.
KEPT = 400_000
LETTERS = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """word -> hashed terms."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = {word, "^" + word[:4], "^" + word[:5]} if len(word) > 3 else {word}
        out = tuple(zlib.crc32(t.encode()) % BUCKETS for t in sorted(terms))
        if len(self) >= KEPT:
            self.clear()
        self[word] = out
        return out


TERMS = Terms()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    out: set[int] = set()
    for word in set(LETTERS.findall(text.lower())) if text else ():
        out.update(TERMS[word])
    return np.sort(np.fromiter(out, np.int32, len(out)))


class FactorizationMachine:
    """Binary features, logistic loss."""

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(buckets, np.float32)
        self.v = rng.normal(0, 0.02, (buckets, factors)).astype(np.float32)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4, rate: float = 0.1, factor_rate: float = 0.005,
            decay: float = 1e-2, significant: float = 10.0, batch: int = 32, seed: int = 4) -> FactorizationMachine:
        """Learn from rows of distinct terms and their 0/1 labels.

        A term's weight starts at half its log odds and moves at a speed that
        grows with the square of its z-score (full speed at ``significant``), so
        the thousands of neutral terms of a long text do not add up to noise. The factors
        of all terms seen at least twice are learned, at ``factor_rate``.
        """
        rng = np.random.default_rng(seed)
        n, p = len(rows), float(labels.mean())
        seen, toxic = np.zeros(len(self.w), np.int32), np.zeros(len(self.w), np.int32)
        for r, label in zip(rows, labels):
            seen[r] += 1
            if label:
                toxic[r] += 1
        self.v[seen < 2] = 0  # terms without training examples have no say
        z = (toxic - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p) * (1 - seen / n), 0) + 0.25)
        speed = (np.minimum(np.abs(z) / significant, 1) ** 2).astype(np.float32)
        speed[seen < 2] = 0
        odds = np.log((toxic + 0.5) / (labels.sum() + 1) / ((seen - toxic + 0.5) / (n - labels.sum() + 1)))
        self.w[:] = speed * odds / 2
        self.b = float(np.log(p / (1 - p)))
        gw, gv, gb = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(n), max(1, n // batch)):
                idx = np.concatenate([rows[k] for k in part])
                doc = np.repeat(np.arange(len(part)), [len(rows[k]) for k in part])
                v = self.v[idx]
                total = np.zeros((len(part), v.shape[1]), np.float32)
                np.add.at(total, doc, v)
                squares = np.bincount(doc, (v * v).sum(1), len(part))
                raw = self.b + np.bincount(doc, self.w[idx], len(part)) + 0.5 * ((total * total).sum(1) - squares)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]).astype(np.float32) / len(part)
                uniq, at = np.unique(idx, return_inverse=True)
                dw = np.bincount(at, err[doc], len(uniq)).astype(np.float32)
                dv = np.zeros((len(uniq), v.shape[1]), np.float32)
                np.add.at(dv, at, err[doc, None] * (total[doc] - v))
                dv += decay * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                gb += float(err.sum()) ** 2
                self.w[uniq] -= rate * speed[uniq] * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= factor_rate * dv / np.sqrt(gv[uniq])
                self.b -= rate * float(err.sum()) / gb ** 0.5
        return self

    def raw(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        out = []
        for r in rows:
            v = self.v[r]
            total = v.sum(0)
            out.append(self.b + float(self.w[r].sum()) + 0.5 * float(total @ total - (v * v).sum()))
        return np.array(out)

    def score(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5) -> FactorizationMachine:
    """A model from a bounded labelled sample: at most ``rows`` documents, a third of them toxic where there are as many."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in marked.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda k, n: marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, rows // 3).unionAll(first(0, rows - rows // 3))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")),
                                           pa.array([features(t).tobytes() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.binary())],
                                          names=["toxic", "terms"])

    # the sample has at most `rows` (doc_id, toxic) pairs
    picked = id_and_text(docs).join(F.broadcast(sample), "doc_id").select("toxic", "text")
    got = sorted((r["toxic"], bytes(r["terms"])) for r in map_blocks(picked, "toxic int, terms binary", block).collect())
    model = FactorizationMachine()
    y = np.array([t for t, _ in got], np.float32)
    if not len(y) or y.min() == y.max():
        model.v[:] = 0
        model.b = 3.0 if len(y) and y.min() else -3.0
        return model
    model.fit([np.frombuffer(t, np.int32) for _, t in got], y)
    # the sample holds another share of toxic documents than the labels
    model.b += float(np.log(totals[1] / totals[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def scores(docs: DataFrame, model: FactorizationMachine, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (1 + FACTORS) floats

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(features(t) for t in batch.column(1).to_pylist()))],
                                          names=["doc_id", "score"])

    out = map_blocks(id_and_text(docs), "doc_id long, score double", block)
    return out.select("doc_id", (crc_mod("doc_id", folds) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scores(docs, train(docs, read_table(spark, sf_dir, "labels")))
