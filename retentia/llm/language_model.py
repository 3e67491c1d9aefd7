"""Operator 3: language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts: an n-gram seen c times is entered under its
levels 1 .. 1 + floor(log2 c), and its count is read back by probing level after
level until one is missing. Scores are smoothed bigram probabilities,
(c(v w) + MU p(w)) / (c(v) + MU), with all counts from such probes; p(w) is the
add-one-half unigram estimate.

How the work is spread (the corpus is read once):

1. Texts are cut into blocks. A block stores its own dictionary (hash of each
   distinct token), its documents as dictionary indexes, and its training counts.
2. Unigram and bigram counts go to buckets by hash, one binary row per block and
   bucket, so a token that stands in every document costs one entry per block.
   Each bucket sums its counts and builds its own part of the filter, ``BITS`` bits
   per entry, so the false-positive rate does not depend on the corpus.
3. A part is probed where it was built: each bucket answers every block with the
   levels of its n-grams, those of held-out texts included, and with exact unigram
   counts. No part is gathered or broadcast. N-grams of held-out texts only are in no
   part; the share that reads as present is the measured false-positive rate (logged).
4. Blocks meet their answers again and are scored.

Defined results: null and empty texts are one end token; repeated rows are
scored (and counted) each on their own; without training rows every count is 0;
an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import textarrays as ta
from retentia.llm.common import crc_mod, id_and_text, map_blocks, materialize, read_table, shuffle_partitions, utf8

log = logging.getLogger(__name__)

BLOCK = 4 << 20
BITS = 10
PROBES = 4
LEVELS = 40
MU = 50.0
#: Hash of the end token, which is also what stands before the first word.
END = ta.mix(np.array([0x1E4D], np.uint64))[0]

PAYLOAD = "docs binary, sizes binary, held binary, ids binary, dictionary binary, counts binary"


def packed(ids: np.ndarray) -> bytes:
    """Indexes below 2**32, byte planes compressed."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """One row per block: its documents, its dictionary (sorted), its tokens, and its training counts."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(batch.column(1))
        starts, ends, first = ta.word_spans(buf, offs)
        words = ta.span_hashes(buf, starts, ends, ta.LOWER_VALUE)
        hashes = np.insert(words, first[1:], END)  # an end after each text
        sizes = np.diff(first) + 1
        dictionary, ids = np.unique(hashes, return_inverse=True)
        is_held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(ids[np.repeat(~is_held, sizes)], minlength=len(dictionary))
        doc_ids = batch.column(0)
        known = np.asarray(doc_ids.is_valid()).astype(np.int64)
        raw = [np.concatenate([np.asarray(doc_ids.fill_null(0)).astype(np.int64), known]).tobytes(), sizes.astype(np.int64).tobytes(),
               is_held.astype(np.uint8).tobytes(), packed(ids), dictionary.tobytes(), counts.astype(np.uint32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], names=[f.split()[0] for f in PAYLOAD.split(", ")])

    marked = id_and_text(docs, (crc_mod("doc_id", folds) == held).alias("held"))
    # the names are fixed once the table is written
    return map_blocks(marked, PAYLOAD, block, BLOCK).withColumn("block", F.monotonically_increasing_id())


def rows_of(batches):
    """One row after another, as a dictionary; only one is copied out of its batch at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def previous(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end token before the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def _bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ta.pair_hash(a, b, 2)


def distinct_bigrams(dictionary: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second word (dictionary indexes) and key of each distinct bigram of a block, and the bigram of each token."""
    pairs, at = np.unique(previous(ids, sizes, int(np.searchsorted(dictionary, END))) * len(dictionary) + ids, return_inverse=True)
    v, w = pairs // len(dictionary), pairs % len(dictionary)
    return v, w, _bigram(dictionary[v], dictionary[w]), at


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the keys' upper half; the lower half is independent of the bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(ordered: np.ndarray, buckets: int):
    """(bucket, from, to) of the buckets that occur in sorted keys."""
    cuts = np.searchsorted(bucket_of(ordered, buckets), np.arange(buckets + 1))
    return [(int(k), int(cuts[k]), int(cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts))]


def unigram_rows(stored: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, start, keys, counts: a run of each block's dictionary."""

    def send(batches):
        for r in rows_of(batches):
            keys, n = np.frombuffer(r["dictionary"], np.uint64), np.frombuffer(r["counts"], np.uint32)
            got = _cuts(keys, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in got], pa.int32()), pa.array([r["block"]] * len(got), pa.int64()), pa.array([i for _, i, _ in got], pa.int64()),
                 pa.array([keys[i:j].tobytes() for _, i, j in got], pa.binary()), pa.array([n[i:j].tobytes() for _, i, j in got], pa.binary())],
                names=["bucket", "block", "start", "keys", "counts"])

    return stored.select("block", "dictionary", "counts").mapInArrow(send, "bucket int, block long, start long, keys binary, counts binary")


def bigram_rows(stored: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, start, keys (lower halves), counts: a run of each block's bigrams by key, counted in training texts."""

    def send(batches):
        for r in rows_of(batches):
            dictionary, sizes = np.frombuffer(r["dictionary"], np.uint64), np.frombuffer(r["sizes"], np.int64)
            ids = unpacked(r["ids"], int(sizes.sum()))
            _, _, keys, at = distinct_bigrams(dictionary, ids, sizes)
            train = np.repeat(np.frombuffer(r["held"], np.uint8) == 0, sizes)
            n = np.bincount(at[train], minlength=len(keys))
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.uint32)
            low, got = keys.astype(np.uint32), _cuts(keys, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in got], pa.int32()), pa.array([r["block"]] * len(got), pa.int64()), pa.array([i for _, i, _ in got], pa.int64()),
                 pa.array([low[i:j].tobytes() for _, i, j in got], pa.binary()), pa.array([n[i:j].tobytes() for _, i, j in got], pa.binary())],
                names=["bucket", "block", "start", "keys", "counts"])

    return stored.select("block", "sizes", "held", "ids", "dictionary").mapInArrow(send, "bucket int, block long, start long, keys binary, counts binary")


def _buckets_of(batches):
    """(bucket, rows) from batches that are sorted by bucket."""
    bucket, rows = None, []
    for r in rows_of(batches):
        if r["bucket"] != bucket and rows:
            yield bucket, rows
            rows = []
        bucket = r["bucket"]
        rows.append(r)
    if rows:
        yield bucket, rows


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def level_keys(low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = ta.pair_hash(low, low, 100 + level)
    return a, ta.mix(a ^ ta.MIX[3]) | np.uint64(1)


def filter_part(low: np.ndarray, counts: np.ndarray, limit: int | None = None) -> bytes:
    """The filter of one bucket's n-grams (lower halves of their keys), ``BITS`` bits per entry; a ``limit`` in bytes, which the operator never sets, makes it denser."""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    size = int(max(64, BITS * levels.sum())) // 8 * 8
    if limit is not None:
        size = min(size, limit * 8)
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        a, b = level_keys(low[levels >= level].astype(np.uint64), level)
        for i in range(PROBES):
            bits[(a + np.uint64(i) * b) % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


ANSWERS = "block long, start long, totals binary, levels binary, distinct long, tokens long, absent long, misread long"


def answered(rows: DataFrame, buckets: int, dtype: type, exact: bool) -> DataFrame:
    """Per block and run the levels that the bucket's filter part gives its n-grams and, if ``exact``, their corpus counts.

    Per bucket (block null): its distinct n-grams and all n-grams in training texts, and how many
    n-grams stand in no training text (absent), and how many of these the filter reads as present (misread).
    """

    def answer(batches):
        z = zstandard.ZstdCompressor(level=1)
        for _, got in _buckets_of(batches):
            uniq, at = np.unique(np.concatenate([np.frombuffer(r["keys"], dtype) for r in got]), return_inverse=True)
            n = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in got])
            total = np.bincount(at, n, len(uniq)).astype(np.int64)
            low, some = uniq.astype(np.uint32), total > 0
            levels = LogFrequencyFilter({0: filter_part(low[some], total[some])}, 1).levels(low.astype(np.uint64)).astype(np.uint8)
            cuts = np.cumsum([0, *(len(r["counts"]) // 4 for r in got)])
            runs = [at[i:j] for i, j in zip(cuts, cuts[1:])]
            zeros = [0] * len(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(r["block"] for r in got), None], pa.int64()), pa.array([*(r["start"] for r in got), None], pa.int64()),
                 pa.array([*(total[k].tobytes() if exact else None for k in runs), None], pa.binary()),
                 pa.array([*(z.compress(levels[k].tobytes()) for k in runs), None], pa.binary()),
                 *(pa.array([*zeros, int(x)], pa.int64()) for x in (some.sum(), total.sum(), (~some).sum(), (levels[~some] > 0).sum()))],
                names=[f.split()[0] for f in ANSWERS.split(", ")])

    return gathered(rows, buckets).mapInArrow(answer, ANSWERS)


def unigram_answers(rows: DataFrame, buckets: int) -> DataFrame:
    return answered(rows, buckets, np.uint64, True)


def bigram_answers(rows: DataFrame, buckets: int) -> DataFrame:
    return answered(rows, buckets, np.uint32, False)


def misread_rate(answers: DataFrame, name: str) -> float | None:
    """The measured false-positive rate of a filter, logged; None if every n-gram stands in training texts."""
    r = answers.where("block IS NULL").agg(F.sum("absent").alias("absent"), F.sum("misread").alias("misread")).first()
    rate = r["misread"] / r["absent"] if r["absent"] else None
    log.info("%s filter: %s of %s absent n-grams read as present, rate %s", name, r["misread"] or 0, r["absent"] or 0, rate)
    return rate


class LogFrequencyFilter:
    """All parts side by side; counts are read by probing one level after another."""

    def __init__(self, parts: dict[int, bytes], buckets: int):
        empty = bytes(8)
        data = [parts.get(k, empty) for k in range(buckets)]
        self.sizes = np.array([8 * len(d) for d in data], np.uint64)
        self.starts = np.cumsum([0, *map(len, data[:-1])]).astype(np.uint64) * np.uint64(8)
        self.bits = np.frombuffer(b"".join(data), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level all of whose lower levels are present; 0 if none is."""
        levels = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(1, LEVELS):
            k = keys[left]
            bucket = bucket_of(k, len(self.sizes))
            a, b = level_keys(k & np.uint64(0xFFFFFFFF), level)
            hit = np.ones(len(k), bool)
            for i in range(PROBES):
                at = self.starts[bucket] + (a + np.uint64(i) * b) % self.sizes[bucket]
                hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[hit]
            if not len(left):
                break
            levels[left] = level
        return levels

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return estimate(self.levels(keys))


def estimate(levels: np.ndarray) -> np.ndarray:
    """Counts as the middle of their levels; 0 at level 0."""
    levels = levels.astype(np.int64)
    return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def score_blocks(stored: DataFrame, singles: DataFrame, both: DataFrame, distinct: int, tokens: int) -> DataFrame:
    space = tokens + 0.5 * (distinct + 1)
    answers = singles.unionAll(both).where("block IS NOT NULL")
    back = answers.groupBy("block").agg(F.collect_list(F.struct("start", "totals", "levels")).alias("parts"))  # a block's dictionary and bigrams
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def score(batches):
        z = zstandard.ZstdDecompressor()
        for r in rows_of(batches):
            dictionary, sizes = np.frombuffer(r["dictionary"], np.uint64), np.frombuffer(r["sizes"], np.int64)
            ids = unpacked(r["ids"], int(sizes.sum()))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            parts = sorted(r["parts"], key=lambda p: p["start"])
            levels = lambda found: np.frombuffer(b"".join(z.decompress(p["levels"]) for p in found), np.uint8)
            unigrams = [p for p in parts if p["totals"] is not None]
            exact = np.concatenate([np.frombuffer(p["totals"], np.int64) for p in unigrams])
            add = lambda x: np.bincount(doc, x, len(sizes))  # noqa: E731, B023
            base = add(np.log10((exact + 0.5) / space)[ids])
            known = add((exact > 0)[ids])
            count = estimate(levels(unigrams))
            v, w, keys, at = distinct_bigrams(dictionary, ids, sizes)
            together = np.empty(len(keys))
            together[np.argsort(keys)] = estimate(levels(p for p in parts if p["totals"] is None))
            p = (together + MU * (count[w] + 0.5) / space) / (np.maximum(count[v], together) + MU)
            total = add(np.log10(np.minimum(p, 1))[at])
            named = np.frombuffer(r["docs"], np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(named[0], mask=named[1] == 0), pa.array(np.frombuffer(r["held"], np.uint8).astype(bool)), pa.array(sizes),
                 pa.array(known.astype(np.int64)), pa.array(base), pa.array(total)], names=[f.split()[0] for f in schema.split(", ")])

    return stored.drop("counts").join(back, "block").mapInArrow(score, schema)


def language_scores(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    buckets = shuffle_partitions(docs.sparkSession)
    stored = materialize(blocks(docs, folds, held), "lm-blocks")
    singles = materialize(unigram_answers(unigram_rows(stored, buckets), buckets), "lm-counts")
    both = materialize(bigram_answers(bigram_rows(stored, buckets), buckets), "lm-levels")
    totals = singles.where("block IS NULL").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    for name, answers in (("unigram", singles), ("bigram", both)):
        misread_rate(answers, name)
    distinct, tokens = totals["v"] or 0, totals["n"] or 0
    scored = score_blocks(stored, singles, both, distinct, tokens)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read_table(spark, sf_dir, "documents"))
