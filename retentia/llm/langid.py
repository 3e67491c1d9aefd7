"""Operator 8: language identification by a bidirectional recurrent network over bytes.

Two gated recurrent networks read windows of ``WINDOW`` bytes forwards and
backwards; their states at every byte give that position a distribution over the
learned languages, and a document's distribution is the mean over all its
positions. A whole text is read as consecutive windows, thousands side by side,
so one step of the network is one matrix product for all of them.

Training: numpy back-propagation through time (Adam) on ``WINDOWS`` windows from
each of about ``TRAIN_ROWS`` documents chosen by hash; windows lie evenly over
the whole text. The learned model has a fixed size.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
repeated documents are predicted each on their own; without training rows every
text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from retentia.llm.common import hashed_share, unused, crc_mod, id_and_text, map_blocks, read_table, text_array, utf8

WINDOW = 64
HIDDEN = 8
TRAIN_ROWS = 1500
WINDOWS = 6
#: Windows read side by side.
LANES = 8192
UND = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction. ``table`` holds each byte's input to the gates (update, reset) and the candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.c = rng.normal(0, hidden ** -0.5, (hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States after each byte: x is (time, lanes). With ``keep``, also what back-propagation needs."""
        steps, lanes = x.shape
        n = len(self.u)
        states = np.empty((steps, lanes, n), np.float32)
        h, kept = np.zeros((lanes, n), np.float32), []
        for t in range(steps):
            a = self.table[x[t]]
            gates = sigmoid(a[:, :2 * n] + h @ self.u)
            z, r = gates[:, :n], gates[:, n:]
            rh = r * h
            cand = np.tanh(a[:, 2 * n:] + rh @ self.c)
            new = h + z * (cand - h)
            if keep:
                kept.append((h, z, r, rh, cand))
            states[t] = h = new
        return (states, kept) if keep else states

    def back(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, from those of the states, through all steps."""
        n = len(self.u)
        g_table, g_u, g_c = (np.zeros_like(p) for p in (self.table, self.u, self.c))
        carry = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, cand = kept[t]
            d = d_states[t] + carry
            d_cand = d * z * (1 - cand * cand)
            d_rh = d_cand @ self.c.T
            d_gates = np.concatenate([d * (cand - h) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            g_u += h.T @ d_gates
            g_c += rh.T @ d_cand
            np.add.at(g_table, x[t], np.concatenate([d_gates, d_cand], 1))
            carry = d * (1 - z) + d_rh * r + d_gates @ self.u.T
        return {"table": g_table, "u": g_u, "c": g_c}


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 8) -> LanguageModel:
        rng = np.random.default_rng(seed)
        return cls(languages, Gru(rng, hidden), Gru(rng, hidden),
                   rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, lanes, languages): the label distribution of every byte."""
        both = np.concatenate([self.forward.run(x), self.backward.run(x[::-1])[::-1]], 2)
        logits = both @ self.out + self.bias
        np.exp(logits - logits.max(2, keepdims=True), out=logits)
        return logits / logits.sum(2, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 8) -> LanguageModel:
        """windows: (count, WINDOW) bytes. Every position of a window has the window's label."""
        rng = np.random.default_rng(seed)
        params = {("f", k): getattr(self.forward, k) for k in ("table", "u", "c")} | {("b", k): getattr(self.backward, k) for k in ("table", "u", "c")}
        params |= {("o", "out"): self.out, ("o", "bias"): self.bias}
        m, s = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        # each language is drawn as often
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        n = len(self.forward.u)
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, batch // len(groups) + 1) for g in groups if len(g)])
            x, y = windows[pick].T, labels[pick]
            f, kept_f = self.forward.run(x, True)
            b, kept_b = self.backward.run(x[::-1], True)
            both = np.concatenate([f, b[::-1]], 2)
            logits = both @ self.out + self.bias
            p = np.exp(logits - logits.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            p /= p.shape[0] * p.shape[1]
            d = p @ self.out.T
            grads = {("o", "out"): np.tensordot(both, p, ([0, 1], [0, 1])), ("o", "bias"): p.sum((0, 1))}
            grads |= {("f", k): g for k, g in self.forward.back(x, kept_f, d[:, :, :n]).items()}
            grads |= {("b", k): g for k, g in self.backward.back(x[::-1], kept_b, d[::-1, :, n:]).items()}
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                params[k] -= rate * (1 - 0.8 * step / steps) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, languages): the mean distribution over all bytes of each text (zeros for an empty one)."""
        sizes = np.diff(offs)
        total = np.zeros((len(sizes), len(self.languages)))
        lanes = -(-sizes // WINDOW)  # consecutive windows of each text, the last one shorter
        row = np.repeat(np.arange(len(sizes)), lanes)
        at = offs[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        length = np.minimum(offs[row + 1] - at, WINDOW)
        for k in range(0, len(row), LANES):
            r, a, n = row[k:k + LANES], at[k:k + LANES], length[k:k + LANES]
            # a shorter window repeats its bytes up to the full length, so that it is read like any other
            x = buf[a + np.arange(WINDOW)[:, None] % n]
            p = self.positions(x)
            p *= (np.arange(WINDOW)[:, None] < n)[:, :, None]
            np.add.at(total, r, p.sum(0))
        return total / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """A model from about ``rows`` documents with a language outside the held-out fold; None without any."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != held))
    n = known.select("lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    languages = sorted(r["lang"] for r in n)
    if not languages:
        return None
    # the share of each language's rows that gives it an equal part of the sample
    share = F.create_map(*[F.lit(x) for r in n for x in (r["lang"], min(1.0, rows / len(n) / r["n"]))])
    # rows that repeat id and text are in the sample once, so that it does not grow with them
    sample = known.where(hashed_share(share[F.col("lang")])).dropDuplicates(["doc_id", "text"])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, out = [], []
        for lang, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
            b = text.encode()
            for a in np.unique(np.linspace(0, max(0, len(b) - WINDOW), WINDOWS).astype(int)):
                if len(b):
                    w = b[a:a + WINDOW]
                    out.append((w * WINDOW)[:WINDOW])
                    langs.append(lang)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"])) for r in map_blocks(sample, "lang string, bytes binary", block).collect())
    if not got:
        return None
    windows = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(x) for x, _ in got])
    return LanguageModel.new(languages).fit(windows, labels)


def labelled(docs: DataFrame, model: LanguageModel | None, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score added under ``prefix``; all other columns stay."""
    letters, best, top = (f"{prefix}{x}" for x in ("letters", "lang_pred", "score"))
    letters = unused(docs, letters)
    marked = docs.withColumn(letters, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            found, score = np.full(batch.num_rows, UND), np.zeros(batch.num_rows)
        else:
            p = model.documents(*utf8(text_array(batch)))
            found, score = np.array(model.languages)[p.argmax(1)], np.minimum(p.max(1), 1.0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score)], names=[*batch.schema.names, best, top])

    schema = StructType([*marked.schema.fields, StructField(best, StringType()), StructField(top, DoubleType())])
    return map_blocks(marked, schema, block).withColumns({
        best: F.when(F.col(letters), F.col(best)).otherwise(UND),
        top: F.when(F.col(letters), F.col(top)).otherwise(F.lit(0.0))}).drop(letters)


def predict(docs: DataFrame, model: LanguageModel | None, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    return labelled(id_and_text(docs), model).select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
