"""Operator 5: packing token pieces into sequences by minimum bin slack.

Per bin: the longest remaining piece is fixed, and a bitset subset-sum dynamic
program over the lengths still available finds the fullest combination for the
rest of the bin; the combination is removed. Pieces of one length are
interchangeable, so the program runs on the histogram of lengths, which has at
most ``capacity`` entries whatever the corpus size, and a combination is taken as
often as the remaining counts allow (a *pattern* with copies). Pieces then get a
rank within their length and look up their slot in the patterns' rank ranges.

Ranks are distributed: each length is salted into hash buckets, so a length that
holds a third of all pieces is ranked by many tasks.

Defined results: null and empty texts are one piece of one token (the end id);
repeated rows are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.byte_bpe import Chunked, Vocabulary, split_special
from retentia.llm.common import id_and_text, map_blocks, materialize, read_table

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that a task ranks.
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.vocabulary.ranks, special_tokens={})
        self.chunks = Chunked(lambda text: array("I", bpe.encode_ordinary(text)).tobytes())

    def __call__(self, text: str) -> bytes:
        out = []
        for part, special in split_special(self.vocabulary, text):
            out += self.chunks(part)
            if special is not None:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's ids; a document longer than ``capacity`` has its shorter piece first."""
    end = END_ID.to_bytes(4, "little")

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(path), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = (encode(text) if text else b"") + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
            rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_blocks(id_and_text(docs), PIECES, block, clear=lambda: encoder.cache_clear())


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room`` (bitset subset sum, longest first)."""
    reach, layers, full = 1, [], (1 << room + 1) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        layers.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left > 0:
            step = min(take, left)
            reach |= reach << step * length & full
            left, take = left - step, take * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        uses = 0
        while not before >> total - uses * length & 1:
            uses += 1
        if uses:
            out[length] = uses
            total -= uses * length
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: uses}) patterns that use up the histogram."""
    counts, patterns = {n: c for n, c in histogram.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        uses = fullest(counts, capacity - longest)
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        copies = min(counts[n] // u for n, u in uses.items())
        patterns.append((copies, uses))
        for n, u in uses.items():
            counts[n] -= copies * u
            if not counts[n]:
                del counts[n]
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, uses, first sequence, offset), sorted; each length's ranks are covered without gaps."""
    rows, used, sequence = [], {}, 0
    for copies, uses in patterns:
        offset = 0
        for length, u in sorted(uses.items(), reverse=True):
            rows.append((length, used.get(length, 0), u, sequence, offset))
            used[length] = used.get(length, 0) + copies * u
            offset += u * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (columns of ``PIECES``)."""
    rows = table.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    salted = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = slots(minimum_bin_slack(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")))

    def assign(batches):
        keys = place[:, 0] << 48 | place[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = place[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            copy, k = np.divmod(rank - at[:, 1], at[:, 2])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(at[:, 3] + copy), pa.array(at[:, 4] + k * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(materialize(pieces(read_table(spark, sf_dir, "documents"), path), "pieces"))
