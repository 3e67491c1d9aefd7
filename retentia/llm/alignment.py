"""Operator 12: alignment of two tokenizers' tokens by an associative monoid of fragments.

A text, read as a space and the text, is encoded by a byte-level BPE (A) and a piece
model (B). Byte offsets where tokens of both end cut it into groups; each such offset
links the A and the B token that end there.

A *fragment* holds the tokens that end within a byte range: an open head (up to the
first common end), closed groups, and an open tail (behind the last). Fragments
compose associatively, a tail and the next head closing to one group, so byte ranges
of any size may be aligned on their own:

* texts up to ``CHUNK_BYTES`` are one fragment, made where they lie;
* longer texts are cut into byte ranges, wherever these fall. A range carries the text
  from the last safe cut before it to the next one behind it and keeps the tokens that
  end inside it. Ranges are spread over Spark tasks, and their fragments are folded
  ``FAN`` at a time, round by round, each round's folds in parallel.

A safe cut lies before a single space between other characters: neither tokenizer
joins anything across it, so the tokens between two safe cuts (*units*) are kept for
their next occurrence. Links lie at common ends, so each range counts its own.

Counts of linked id pairs are summed per block of texts before they are shuffled; each
block gets back the counts of the pairs it holds.

Defined results: null and empty texts, and texts whose tokens do not give their bytes
back (such as those with U+2581, which B reads as a space), have no tokens: zeros and
an empty groups_sha256, and they add nothing to the counts. Special strings inside a
text are plain text. Repeated rows and rows that share a doc_id or have none are
aligned each on their own; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.byte_bpe import Vocabulary
from retentia.llm.common import block_ranges, id_and_text, materialize, read_table, uncollected, utf8

#: Texts of one block, whose pairs are counted together.
BLOCK_BYTES = 1 << 20
#: Longer texts are aligned range by range.
CHUNK_BYTES = 1 << 16
#: Fragments folded into one per task and round.
FAN = 16
#: Units a worker keeps before it starts anew; longer ones are not kept.
CACHE, LONG = 200_000, 200

#: A space between two other characters, the second of which is no white space: in a str, and (fewer of them) in UTF-8 bytes.
SAFE = re.compile(r"(?<=[^ ]) (?=\S)")
SAFE_BYTES = re.compile(rb"(?<=[^ ]) (?=[!-~\xc3-\xe0\xe4-\xf4])")
#: A text without this is cut safely at every space.
AWKWARD = re.compile(r"^ | (?:\s|\Z)")

BLOCKS = ("block long, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, "
          "n_links array<long>, links binary, pairs binary, counts binary")
FRAGMENT = "cut boolean, head_a array<int>, head_b array<int>, closed binary, n_closed long, tail_a array<int>, tail_b array<int>"


class Fragment(NamedTuple):
    """Tokens that end within a byte range. Without a common end (``cut``) all are in the head.

    An empty head with ``cut`` says that the range starts at a common end.
    """

    cut: bool
    head: tuple[list[int], list[int]]
    closed: bytes = b""
    n_closed: int = 0
    tail: tuple[list[int], list[int]] = ([], [])


EMPTY = Fragment(False, ([], []))
#: The start of a text: a common end, and nothing else.
START = Fragment(True, ([], []))


def group_text(a: Iterable[int], b: Iterable[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with ``EMPTY`` as its identity."""
    if not f.cut:
        return g._replace(head=(f.head[0] + g.head[0], f.head[1] + g.head[1]))
    a, b = f.tail[0] + g.head[0], f.tail[1] + g.head[1]
    if not g.cut:
        return f._replace(tail=(a, b))
    middle = [group_text(a, b)] if a or b else []
    parts = [f.closed] * (f.n_closed > 0) + middle + [g.closed] * (g.n_closed > 0)
    return Fragment(True, f.head, b";".join(parts), f.n_closed + len(middle) + g.n_closed, g.tail)


def fold(fragments: Iterable[Fragment]) -> Fragment:
    """``compose`` over many; runs of closed groups are joined once."""
    out, parts, n = EMPTY, [], 0
    for g in fragments:
        if not out.cut or not g.cut:
            out = compose(out, g)
            if out.n_closed:  # of g, which was the first with a common end
                parts, n, out = [*parts, out.closed], n + out.n_closed, out._replace(closed=b"", n_closed=0)
            continue
        joint = compose(out, g._replace(closed=b"", n_closed=0))
        parts += [joint.closed] * (joint.n_closed > 0) + [g.closed] * (g.n_closed > 0)
        n += joint.n_closed + g.n_closed
        out = joint._replace(closed=b"", n_closed=0)
    return out._replace(closed=b";".join(parts), n_closed=n)


def whole_text(f: Fragment) -> tuple[int, bytes]:
    """Number of groups and their text, of the fragment of a whole text (which starts and ends at a common end)."""
    ends = [group_text(*f.head)] if f.head[0] or f.head[1] else []
    last = [group_text(*f.tail)] if f.tail[0] or f.tail[1] else []
    return len(ends) + f.n_closed + len(last), b";".join([*ends, *([f.closed] if f.n_closed else []), *last])


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and the B tokens that end together."""
    if not len(ends_b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    hit = ends_b[at] == ends_a
    return np.flatnonzero(hit), at[hit]


class Decimals:
    """Ids as decimal digits, many at a time."""

    def __init__(self, size: int):
        self.width = len(str(size - 1))
        ids = np.arange(size)
        self.length = np.ones(size, np.int64)
        for k in range(1, self.width):
            self.length += ids >= 10 ** k
        place = np.arange(self.width + 1)
        power = self.length[:, None] - 1 - place
        self.digits = (ids[:, None] // 10 ** np.maximum(power, 0) % 10 + ord("0")).astype(np.uint8)

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of closed groups, each with a ``;`` behind it, and where each ends in it.

        ``last_a`` and ``last_b`` are the groups' last tokens; the last group's are the last of ``a`` and ``b``.
        """
        if not len(last_a):
            return np.empty(0, np.uint8), np.empty(0, np.int64)
        number = np.arange(len(last_a))
        place_a = np.arange(len(a)) + np.append(0, last_b[:-1] + 1)[np.repeat(number, np.diff(last_a, prepend=-1))]
        place_b = np.arange(len(b)) + (last_a + 1)[np.repeat(number, np.diff(last_b, prepend=-1))]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        length, rows = self.length[ids], self.digits[ids]
        rows[np.arange(len(ids)), length] = mark
        return rows[np.arange(self.width + 1) <= length[:, None]], np.cumsum(length + 1)[place_b[last_b]]


class Tokens(NamedTuple):
    """The tokens of neighbouring units, whose bytes all come back: ids, and byte ends counted from the first unit's start."""

    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray


class Aligner:
    """Both tokenizers, and the ids of the units a worker has met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        vocabulary = Vocabulary(path_a)
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go on behind a space cannot be cut there")
        self.bytes_a = {rank: token for token, rank in vocabulary.ranks.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.length_b = np.array([len(t) for t in self.bytes_b])
        self.decimals = Decimals(max(len(self.length_a), len(self.length_b)))
        #: part -> ids of both as uint32 bytes, or None where the bytes do not come back
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def ids(self, part: str, b: list[int]) -> tuple[bytes, bytes] | None:
        raw, a = (" " + part).encode(), self.a.encode_ordinary(" " + part)
        if b"".join([self.bytes_b[t] for t in b]) != raw or b"".join([self.bytes_a[t] for t in a]) != raw:
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()

    def units(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each part, a space before it."""
        if len(self.known) > CACHE:
            self.known.clear()
        found = list(map(self.known.get, parts, repeat(0)))
        unknown = [k for k, u in enumerate(found) if u == 0]
        new, once = list({parts[k] for k in unknown}), {}
        for part, b in zip(new, self.b.encode(new, num_threads=1)):
            (self.known if len(part) <= LONG else once)[part] = self.ids(part, b)
        for k in unknown:
            found[k] = once[parts[k]] if parts[k] in once else self.known[parts[k]]
        return found

    def tokens(self, units: list[tuple[bytes, bytes]]) -> Tokens:
        a, b = (np.frombuffer(b"".join([u[k] for u in units]), np.uint32).astype(np.int64) for k in (0, 1))
        return Tokens(a, np.cumsum(self.length_a[a]), b, np.cumsum(self.length_b[b]))

    def fragment(self, t: Tokens) -> tuple[Fragment, np.ndarray]:
        """The fragment, and the linked pairs, of tokens that end within a range."""
        i, j = common_ends(t.ends_a, t.ends_b)
        pairs = (t.a[i] << 32 | t.b[j]).astype(np.uint64)
        if not len(i):
            return Fragment(False, (t.a.tolist(), t.b.tolist())), pairs
        p, q, x, y = i[0] + 1, j[0] + 1, i[-1] + 1, j[-1] + 1
        text, _ = self.decimals.groups(t.a[p:x], t.b[q:y], i[1:] - p, j[1:] - q)
        return Fragment(True, (t.a[:p].tolist(), t.b[:q].tolist()), text[:-1].tobytes(), len(i) - 1, (t.a[x:].tolist(), t.b[y:].tolist())), pairs


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def parts_of(text: str) -> list[str]:
    """A text cut at safe spaces, which are left out."""
    return SAFE.split(text) if AWKWARD.search(text) else text.split(" ")


def block_row(block: int, keys: list, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, sha: list[str], n_links: np.ndarray,
              links: np.ndarray) -> pa.RecordBatch:
    """One row of the blocks table; ``links`` are the pairs of all keys, one behind the other."""
    pairs, index, counts = np.unique(links, return_inverse=True, return_counts=True)
    small = "<u2" if len(pairs) <= 1 << 16 else "<u4"
    lists = [keys, n_a, n_b, n_groups, sha, n_links]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds)),
         pa.array([index.astype(small).tobytes()], pa.binary()), pa.array([pairs.astype("<u8").tobytes()], pa.binary()),
         pa.array([counts.astype("<i8").tobytes()], pa.binary())],
        names=["block", "keys", "n_a", "n_b", "n_groups", "sha", "n_links", "links", "pairs", "counts"])


def aligned_block(align: Aligner, block: int, keys: list, texts: list[str | None]) -> pa.RecordBatch:
    """The blocks row of whole texts."""
    split = [parts_of(t) if t else [] for t in texts]
    flat = align.units(list(chain.from_iterable(split)))
    if None in flat:  # texts with such a unit have no tokens
        kept, at = [], 0
        for k, parts in enumerate(split):
            units = flat[at:at + len(parts)]
            at += len(parts)
            if None in units:
                split[k] = []
            else:
                kept += units
        flat = kept
    t = align.tokens(flat)
    i, j = common_ends(t.ends_a, t.ends_b)
    text, ends = align.decimals.groups(t.a, t.b, i, j)
    raw, ends = memoryview(text), np.append(0, ends)
    # where each text stops: units, then tokens of both and groups
    units = np.append(0, np.cumsum([len(p) for p in split]))
    stop_a, stop_b = (np.append(0, np.cumsum([len(u[k]) // 4 for u in flat]).astype(np.int64))[units] for k in (0, 1))
    stop_g = np.searchsorted(i, stop_a)
    at = ends[stop_g].tolist()
    sha = [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]
    return block_row(block, keys, np.diff(stop_a), np.diff(stop_b), np.diff(stop_g), sha, np.diff(stop_g), (t.a[i] << 32 | t.b[j]).astype(np.uint64))


def short_blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The blocks table of texts that are aligned in one piece; keys are doc_ids."""

    def run(batches):
        align, number = aligner(*paths), TaskContext.get().partitionId() << 32
        with uncollected(align.known.clear):
            for batch in batches:
                _, offs = utf8(batch.column(1))
                for i, j in block_ranges(offs, BLOCK_BYTES):
                    yield aligned_block(align, number, *(c.slice(i, j - i).to_pylist() for c in batch.columns))
                    number += 1

    return docs.mapInArrow(run, BLOCKS)


def cut_ranges(raw: bytes, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(low, high, place of the context, context) of each byte range; the context reaches to safe cuts on both sides."""
    n = len(raw)
    for low in range(0, n, size):
        high = min(low + size, n)
        begin, width = 0, 256
        while low:
            left = max(0, low - width)
            cuts = [m.start() for m in SAFE_BYTES.finditer(raw[left:low + 2]) if left + m.start() <= low]
            if cuts or not left:
                begin = left + cuts[-1] if cuts else 0
                break
            width *= 16
        m = SAFE_BYTES.search(raw, high) if high < n else None
        end = m.start() if m else n
        yield low, high, begin, raw[begin:end]


def ranges(docs: DataFrame, size: int) -> DataFrame:
    """row, range number, low, high, begin and context of the byte ranges of long texts."""

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (low, high, begin, context) in enumerate(cut_ranges((" " + text).encode(), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (row, k, low, high, begin)] + [pa.array([context], pa.binary())],
                                                     names=["row", "k", "low", "high", "begin", "context"])

    return docs.mapInArrow(run, "row long, k long, low long, high long, begin long, context binary")


def range_fragment(align: Aligner, low: int, high: int, begin: int, context: bytes) -> tuple[bool, Fragment, Tokens, np.ndarray]:
    """Whether all bytes of the context come back; the fragment, the tokens and the linked pairs of those that end in low .. high."""
    units = align.units(parts_of(context.decode()[1:]))  # a context starts with the space of its first part
    if None in units:
        none = np.empty(0, np.int64)
        return False, EMPTY, Tokens(none, none, none, none), none.astype(np.uint64)
    t = align.tokens(units)
    (a, b), (c, d) = (np.searchsorted(e + begin, [low, high], "right") for e in (t.ends_a, t.ends_b))
    t = Tokens(t.a[a:b], t.ends_a[a:b], t.b[c:d], t.ends_b[c:d])
    f, pairs = align.fragment(t)
    return True, f if low else compose(START, f), t, pairs


def _fragment_arrays(fragments: list[Fragment]) -> list[pa.Array]:
    ints = pa.list_(pa.int32())
    return [pa.array([f.cut for f in fragments], pa.bool_()), pa.array([f.head[0] for f in fragments], ints),
            pa.array([f.head[1] for f in fragments], ints), pa.array([f.closed for f in fragments], pa.binary()),
            pa.array([f.n_closed for f in fragments], pa.int64()), pa.array([f.tail[0] for f in fragments], ints),
            pa.array([f.tail[1] for f in fragments], ints)]


FRAGMENT_NAMES = ["cut", "head_a", "head_b", "closed", "n_closed", "tail_a", "tail_b"]


def _fragment_of(columns: tuple) -> Fragment:
    cut, head_a, head_b, closed, n, tail_a, tail_b = columns
    return Fragment(cut, (head_a, head_b), closed, n, (tail_a, tail_b))


def range_blocks(found: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """row, k, good, the fragment, and a blocks row (a block of its own) of each byte range."""

    def run(batches):
        align, number = aligner(*paths), TaskContext.get().partitionId() << 32 | 1 << 62  # not a block of short texts
        with uncollected(align.known.clear):
            for batch in batches:
                for i in range(batch.num_rows):
                    row, k, low, high, begin, context = (c[i].as_py() for c in batch.columns)
                    good, f, t, pairs = range_fragment(align, low, high, begin, context)
                    one = [np.array([len(x)]) for x in (t.a, t.b, pairs)]
                    block = block_row(number, [row], *one[:2], np.zeros(1, np.int64), [""], one[2], pairs)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([good], pa.bool_()),
                                                      *_fragment_arrays([f]), *block.columns],
                                                     names=["row", "k", "good", *FRAGMENT_NAMES, *block.schema.names])
                    number += 1

    return found.mapInArrow(run, f"row long, k long, good boolean, {FRAGMENT}, {BLOCKS}")


def folded(fragments: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """One fragment per row of (row, k, fragment), by rounds of folds of ``fan`` neighbours; ``most`` ranges in a row at most."""

    def run(batches):
        key, held = None, []
        for b in batches:
            for row, k, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (row, k // fan) != key:
                    if held:
                        yield one(key, held)
                    key, held = (row, k // fan), []
                held.append(_fragment_of(rest))
        if held:
            yield one(key, held)

    def one(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), *_fragment_arrays([fold(held)])],
                                          names=["row", "k", *FRAGMENT_NAMES])

    state = fragments.select("row", "k", *FRAGMENT_NAMES)
    while most > 1:
        together = state.withColumn("next", F.expr(f"k div {fan}")).repartition("row", "next").sortWithinPartitions("row", "k").drop("next")
        state = together.mapInArrow(run, f"row long, k long, {FRAGMENT}")
        most = -(-most // fan)
    return state


def hashed(fragments: DataFrame) -> DataFrame:
    """row, n_groups and sha of whole texts."""

    def run(batches):
        for b in batches:
            for row, _, *rest in zip(*(c.to_pylist() for c in b.columns)):
                n, text = whole_text(_fragment_of(rest))
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([n], pa.int64()), pa.array([hashlib.sha256(text).hexdigest()])],
                                                 names=["row", "groups", "text_sha"])

    return fragments.mapInArrow(run, "row long, groups long, text_sha string")


def pair_uses(blocks: DataFrame) -> DataFrame:
    """block, pair and the pair's links in that block."""

    def run(batches):
        for b in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in b.columns)):
                p = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(p), pa.array(np.frombuffer(counts, "<i8"))],
                                                 names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "counts").mapInArrow(run, "block long, pair long, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), count: its links in the corpus, best: whether no other A id has more with this B id."""
    total = pair_uses(blocks).groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.expr("pair & 4294967295"))
    best = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per key: n_a, n_b, n_groups, n_links, n_best, count_sum, sha."""
    # a block's answers are as many as its different pairs
    answers = (pair_uses(blocks).select("block", "pair").join(counts, "pair").groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("answers")))
    names = ["keys", "n_a", "n_b", "n_groups", "sha", "n_links", "links"]
    joined = blocks.select("block", *names).join(answers, "block", "left").select(*names, F.col("answers.count").alias("c"), F.col("answers.best").alias("t"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys, n_a, n_b, n_groups, sha, n_links = (b.column(k)[i].values for k in range(6))
                n = n_links.to_numpy()
                if b.column(7)[i].is_valid:
                    count, best = b.column(7)[i].values.to_numpy(), b.column(8)[i].values.to_numpy(zero_copy_only=False)
                else:
                    count, best = np.empty(0, np.int64), np.empty(0, bool)
                links = np.frombuffer(b.column(6)[i].as_py(), "<u2" if len(count) <= 1 << 16 else "<u4")
                at = np.append(0, np.cumsum(n))
                sums = [np.diff(np.append(0, np.cumsum(x[links].astype(np.int64)))[at]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([keys, n_a, n_b, n_groups, n_links, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), sha],
                                                 names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(run, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    paths, texts = (path_a, path_b), id_and_text(docs)
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    short = materialize(short_blocks(texts.where(~is_long), paths), "alignment")
    # long texts get a number once, which their ranges carry
    long = materialize(texts.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long-texts")
    spread = ranges(long.select("row", "text"), chunk_bytes).repartition("row", "k")
    found = materialize(range_blocks(spread, paths), "ranges")
    whole = found.groupBy("row").agg(F.min("good").alias("good")).where("good").select("row")
    kept = found.join(whole, "row", "left_semi")
    most = found.agg(F.max("k")).first()[0]
    columns = [c.split(" ")[0] for c in BLOCKS.split(", ")]
    blocks = short.select(*columns).unionAll(kept.select(*columns))
    counts = materialize(pair_counts(blocks), "pair-counts")
    digest = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    of_short = scored(short, counts).select(F.col("key").alias("doc_id"), *digest)
    added = scored(kept.select(*columns), counts).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")))
    groups = hashed(folded(kept, 0 if most is None else most + 1, fan))
    of_long = (long.select("row", "doc_id").join(added, F.col("row") == F.col("key"), "left").join(groups, "row", "left")
               .select("doc_id", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("n_a", "n_a"), ("n_b", "n_b"), ("groups", "n_groups"),
                       ("n_links", "n_links"), ("n_best", "n_best"), ("count_sum", "count_sum"))), F.coalesce("text_sha", F.lit("")).alias("groups_sha256")))
    return of_short.unionAll(of_long)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
