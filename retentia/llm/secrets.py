"""Operator 6: secrets in texts, by patterns and by character Markov models.

The base patterns are kept as they are. On top of them, every run of token
characters is scored by two first-order character Markov models, one of random
strings and one of ordinary identifiers and words; a run whose log-likelihood
ratio exceeds the thresholds is a span of kind ``random``.

Training: labelled samples from a bounded number of documents (``TRAIN_ROWS``,
chosen by hash): what the base patterns find there is labelled random, words
and identifiers elsewhere ordinary; plus ``SEEDED`` random strings per alphabet,
so that tables without secrets can be trained on too. The models are two fixed
68 x 67 count tables, summed by Spark.

Defined results: null and empty texts have no spans (zero counts, the hash of
the empty string, an empty span list); repeated rows are scanned each on their
own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import hashed_share, id_and_text, map_blocks, read_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words whose presence (in any case) an ``assign`` match needs.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9_-]{4,}")
STATES = len(CHARS) + 1
CODE = np.full(256, -1)
CODE[list(CHARS.encode())] = np.arange(len(CHARS))

TRAIN_ROWS = 3000
SEEDED = 200
#: A run is random if its ratio exceeds both, in nats: in total and per character.
MIN_TOTAL, MIN_MEAN = 16.0, 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a hex run of 32 characters lies inside a run of token characters
    for run in RUN.finditer(text):
        if run.end() - run.start() >= 32:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def transitions(s: str) -> np.ndarray:
    """Cells of a flattened (previous state, character) table; the first previous state is the start."""
    code = CODE[np.frombuffer(s.encode(), np.uint8)]
    previous = np.empty_like(code)
    previous[0], previous[1:] = STATES - 1, code[:-1]
    return previous * len(CHARS) + code


def seeded_counts() -> np.ndarray:
    rng = random.Random(6)
    out = np.zeros(STATES * len(CHARS), np.int64)
    for alphabet in ("0123456789abcdef", CHARS[:62], CHARS[:64], CHARS[:36].upper()):
        alphabet = "".join(sorted(set(alphabet)))
        for _ in range(SEEDED):
            np.add.at(out, transitions("".join(rng.choices(alphabet, k=rng.randint(16, 48)))), 1)
    return out


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each transition."""
    rows = docs.count()
    cells = STATES * len(CHARS)
    sample = id_and_text(docs).where(hashed_share(min(1.0, TRAIN_ROWS / max(rows, 1))))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(2 * cells, np.int64)
        for text in batch.column(1).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            for start, kind, end in spans:
                secret = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
                np.add.at(n, transitions("".join(c for c in secret if c in CHARS)), 1) if any(c in CHARS for c in secret) else None
            at = 0
            for start, _, end in [*spans, (len(text), 0, len(text))]:
                words = ORDINARY.findall(text, at, max(at, start))
                if words:
                    np.add.at(n, cells + np.concatenate([transitions(w) for w in words]), 1)
                at = max(at, end)
        used = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["cell", "n"])

    n = np.zeros(2 * cells, np.int64)
    summed = map_blocks(sample, "cell long, n long", count).groupBy("cell").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most 2 * 68 * 67 rows
        n[r["cell"]] = r["n"]
    random_n, ordinary_n = n[:cells] + seeded_counts(), n[cells:]

    def log_p(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(STATES, len(CHARS)).astype(float)
        unigram = (c.sum(0) + 0.5) / (c.sum() + 0.5 * len(CHARS))
        return np.log((c + 4 * unigram) / (c.sum(1, keepdims=True) + 4)).ravel()

    return log_p(random_n) - log_p(ordinary_n)


def random_spans(text: str, ratio: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of token characters that look random; base spans cut a run, and each piece is scored on its own."""
    out = []
    for m in RUN.finditer(text):
        at = m.start()
        cuts = [(s, e) for s, _, e in sorted(base) if s < m.end() and m.start() < e]
        for s, e in [*cuts, (m.end(), m.end())]:
            start, end = at, min(s, m.end())
            at = max(at, e)
            if not RUN.fullmatch(text, start, end):
                continue
            total = float(ratio[transitions(text[start:end])].sum())
            if total > MIN_TOTAL and total > MIN_MEAN * (end - start):
                out.append((start, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and all spans (code points, end exclusive)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            for k in range(3):
                cols[k].append(sum(x[1] == k for x in base))
            cols[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
            cols[4].append(listed(base + random_spans(text, ratio, base)) if text else "")
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                                          names=[f.split()[0] for f in schema.split(", ")])

    return map_blocks(id_and_text(docs), schema, block)


def redact(docs: DataFrame, ratio: np.ndarray, mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of ``text`` replaced by ``mask``; other columns stay.

    A column named ``n_chars`` is the text's length and follows it.
    """
    def one(text):
        if not text:
            return text
        base = base_spans(text)
        out, at = [], 0
        for start, _, end in sorted(base + random_spans(text, ratio, base)):
            if end <= at:
                continue
            out += [text[at:max(at, start)], mask] if start >= at else []
            at = end
        return "".join([*out, text[at:]])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index("text")
        masked = pa.array([one(text) for text in batch.column(k).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([masked if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    typed = docs.withColumn("text", F.col("text").cast("string"))
    out = map_blocks(typed, typed.schema, block)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
