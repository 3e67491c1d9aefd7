"""Operator 10: exact token counts at every prefix, by dynamic programming.

For a pre-token w, ``last[i]`` is the last token of the encoding of the prefix
w[:i]. It is the one vocabulary token t ending at i such that the encoding of
w[:i - len(t)] followed by t is a fixed point of the merges, which holds exactly
if the pair (last token before, t) encodes to itself. The count of a prefix is
then one more than that of the shorter prefix. So a single pass yields the exact
count of *every* prefix, and truncation or budget questions read the table.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as one token each (the library's default); repeated rows are
counted each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.byte_bpe import Chunked, Vocabulary, split_special
from retentia.llm.common import id_and_text, id_array, map_blocks, read_table, text_array

#: Pairs and pre-tokens kept before a worker starts anew.
KEPT = 1_000_000
#: Pre-tokens that agree on so many first bytes share the start of their tables.
STEM = 6


class PrefixCounter:
    """Exact token counts of all prefixes under a byte-level BPE."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks = vocabulary.ranks
        self.endings = self.lengths_by_ending()
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        #: (rank << 32 | rank) -> whether the two tokens stay apart.
        self.pairs: dict[int, bool] = {}
        self.tables: dict[bytes, list[int]] = {}
        self.stems: dict[bytes, tuple[list[int], list[int]]] = {}
        self.totals = Chunked(self.ordinary_total)

    def lengths_by_ending(self) -> dict[bytes, list[int]]:
        """Lengths, longest first, of the tokens that can end where the last (up to three) bytes are these.

        Three bytes that end no token of three or more are not listed: there, lengths 2 and 1 remain.
        """
        found: dict[bytes, set[int]] = {}
        for t in self.ranks:
            found.setdefault(t[-3:], set()).add(len(t))
        for end, lengths in found.items():
            lengths.update(range(1, len(end)))
        return {end: sorted(lengths, reverse=True) for end, lengths in found.items()}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; only used on pairs of tokens."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined tokens of ranks a and b is a, b."""
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        left, right = self.tokens[a], self.tokens[b]
        found = self.pairs[a << 32 | b] = self.merge(left + right) == [left, right]
        return found

    def prefixes(self, piece: bytes) -> list[int]:
        """counts[i]: tokens of piece[:i], for one pre-token."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        rank_of, pair, lengths, short = self.ranks.get, self.pairs.get, self.endings.get, (2, 1)
        last, counts = [-1], [0]  # ranks of the last tokens
        stem = self.stems.get(piece[:STEM]) if len(piece) > STEM else None
        if stem is not None:
            last, counts = stem[0].copy(), stem[1].copy()
        for i in range(len(last), len(piece) + 1):
            for n in lengths(piece[i - 3:i] if i > 3 else piece[:i], short):
                if n > i or (rank := rank_of(piece[i - n:i])) is None:
                    continue
                if n == i:
                    break
                before = last[i - n]
                fits = pair(before << 32 | rank)
                if fits or fits is None and self.stays(before, rank):
                    break
            last.append(rank)
            counts.append(counts[i - n] + 1)
        if len(piece) > STEM and stem is None:
            if len(self.stems) >= KEPT // 4:
                self.stems.clear()
            self.stems[piece[:STEM]] = last[:STEM + 1], counts[:STEM + 1]
        if len(piece) <= 64:
            if len(self.tables) >= KEPT // 4:
                self.tables.clear()
            self.tables[piece] = counts
        return counts

    def ordinary_total(self, text: str) -> int:
        return sum(self.prefixes(p.encode())[-1] for p in self.vocabulary.pattern.findall(text))

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(sum(self.totals(part)) + (special is not None) for part, special in split_special(self.vocabulary, text))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The stored counts of one ordinary text; answers questions about any character prefix.

    ``starts`` are the pre-tokens' start positions and ``before`` the tokens up
    to them. Cutting inside a pre-token can only change it and white space just
    before it, so a prefix reads ``before`` there and the stored counts of the
    cut pre-tokens; nothing is encoded again.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        spans = [m.span() for m in counter.vocabulary.pattern.finditer(text)]
        self.starts = [s for s, _ in spans]
        per = [counter.prefixes(text[s:e].encode())[-1] for s, e in spans]
        self.before = [0, *accumulate(per)]

    def count(self, end: int) -> int:
        """Exact tokens of text[:end]."""
        if end >= len(self.text):
            return self.before[-1]
        k = max(0, bisect_left(self.starts, end) - 2)
        if not self.starts:
            return 0
        return self.before[k] + sum(self.counter.prefixes(p.encode())[-1]
                                    for p in self.counter.vocabulary.pattern.findall(self.text[self.starts[k]:end]))

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        k = bisect_right(self.before, budget) - 1
        if k >= len(self.starts):
            return len(self.text)
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return next((e for e in range(stop, self.starts[k], -1) if self.count(e) <= budget), self.starts[k])


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(Vocabulary(path))


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = counter(path).total
        return pa.RecordBatch.from_arrays(
            [id_array(batch), pa.array([total(t) if t else 0 for t in text_array(batch).to_pylist()], pa.int64()),
             batch.column(batch.schema.get_field_index("n_bytes"))], names=["doc_id", "n_tokens", "n_bytes"])

    sized = id_and_text(docs, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_blocks(sized, "doc_id long, n_tokens long, n_bytes long", block)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and ``n_kept_chars``: the longest prefix of each text within a token budget (null text: 0).

    Special strings are read as ordinary text here, since a cut may fall inside one.
    """

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        return pa.RecordBatch.from_arrays(
            [id_array(batch), pa.array([c.table(t).longest_within(budget) if t else 0 for t in text_array(batch).to_pylist()],
                                       pa.int64())], names=["doc_id", "n_kept_chars"])

    return map_blocks(id_and_text(docs), "doc_id long, n_kept_chars long", block)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
