"""Operator 13: the token ids of a corpus, written in Simple-8b files and read back.

Rows are range-partitioned and sorted by doc_id, encoded where they then lie, and
written by Spark as one row per *segment*: a run of whole documents with at most
``SEGMENT_IDS`` ids (or one longer document). A segment row holds

    part, segment    its place: the task that wrote it, and its number there
    start            ids of the part before the segment
    n_ids            ids in the segment
    doc_ids          the documents, in order
    lengths          a Simple-8b stream of their numbers of ids
    ids              a Simple-8b stream of all their ids, end ids included

so the concatenation of all segments by (part, segment) is the whole stream. A
document's place in the stream is the part's base (a sum over parts, one row each)
plus ``start`` plus the ids before it in the segment. Files are committed by
Spark's writer: a lost executor's segments are written again by another task.

Rows are ordered by (doc_id, hash of the text, place in the input): rows with one
doc_id, or even one text, are dealt to as many tasks as their bytes need.

Defined results: null and empty texts hold the end id alone; rows without a doc_id
come first; rows that share a doc_id follow one another, each a document of its
own; special strings inside a text become their ids, as the library reads them; an
empty table gives files without segments. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm import simple8b
from retentia.llm.common import BLOCK_BYTES, block_ranges, id_and_text, read_table, uncollected, utf8
from retentia.session import checkpoint_dir

END_ID = 1
SEGMENT_IDS = 1 << 18
#: White-space chunks a worker keeps before it starts anew; longer ones are not kept.
CACHE, LONG = 800_000, 200
#: Marks that the pattern cuts off a word or number before them.
ENDS = (b",", b".")
SEGMENTS = "part int, segment int, start long, n_ids long, n_docs int, doc_ids array<long>, lengths binary, ids binary"


class WordEncoder:
    """Ids of a text, as little-endian uint32 bytes, by the tokenizers library.

    The vocabulary's rules drop white space and join nothing across it, so the ids
    of a text are those of its chunks between ASCII white space, which are kept for
    their next occurrence. Unseen chunks of a block go to the library together:

    * chunks of plain letters, digits and marks up to ``SIMPLE`` are normalised by
      the library's normaliser and cut by its pattern into words, which recur in
      many chunks; unseen words are encoded in one call by the library's model, and
      an id that ends a word ends the word's ids;
    * all others (special strings, control characters, other scripts) are encoded
      as they are in one call, with a chunk of one zero byte between them as a mark,
      and chunks that hold a zero byte themselves one by one.
    """

    MARK = "\0"
    # The vocabulary's own splitting pattern and its mark of a word's last token.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"
    #: Only characters from ``!`` up to this one are cut into words here; Unicode versions agree on them.
    SIMPLE = "\u052f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        self.pattern = regex.compile(self.PATTERN)
        self.simple = re.compile(rb"[!-;=-~\xc2-\xd4\x80-\xbf]*")  # no "<", which starts the special strings
        self.mark = self.whole(self.MARK)
        if len(self.mark) != 1:
            raise ValueError("the mark must be one token")
        self.known: dict[bytes, bytes] = {}
        self.known_words: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Between tasks, caches that are more than half full start anew."""
        if len(self.known) + len(self.known_words) > CACHE:
            self.known.clear()
            self.known_words.clear()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Make unknown ``chunks`` known; the ids of those that are not kept are returned."""
        known, simple = self.known, self.simple.fullmatch
        plain, rest, others, once, ended = [], [], [], {}, []
        for c in chunks:
            if len(c) > LONG or b"\0" in c:
                once[c] = np.array(self.whole(c.decode()), "<u4").tobytes()
                continue
            if c[-1:] in ENDS and c[-2:-1].isalnum():  # a word or number, and one mark behind it
                ended.append(c)
                c = c[:-1]
                if c in known:
                    continue
            if c.isalpha():
                plain.append(c)
            else:
                (rest if simple(c) else others).append(c)
        if ended:
            rest += [e for e in ENDS if e not in known]
        self.by_words(plain, rest)
        self.by_marks(others)
        for c in ended:
            known[c] = known[c[:-1]] + known[c[-1:]]
        return once

    def words_of(self, normal: str) -> list[str]:
        """The pattern's pieces of a normalised chunk; plain words, and those before one comma or full stop, need no search."""
        if normal.isalpha():
            return [normal]
        if normal[-1] in ",." and normal[:-1].isalpha():
            return [normal[:-1], normal[-1]]
        return self.pattern.findall(normal)

    def by_words(self, plain: list[bytes], rest: list[bytes]) -> None:
        """Chunks of ASCII letters alone, and other simple ones, from the words they consist of."""
        normal = self.library.normalizer.normalize_str(b" ".join(rest).decode()).split(" ") if rest else []
        if len(normal) != len(rest) or not all(normal) or max(map(max, normal), default="") > self.SIMPLE:
            self.by_marks(rest)  # white space or other characters came out
            rest, normal = [], []
        cut = [[w.encode() for w in self.words_of(t)] for t in normal]
        lower = [c.lower() for c in plain]
        known, words = self.known, self.known_words
        if len(words) > CACHE:
            words.clear()
        need = {w for w in lower if w not in words}
        need.update(w for ws in cut for w in ws if w not in words)
        if need:
            new = list(need)
            ids = np.array(self.words.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) != len(new):
                raise ValueError("a word must end with one word-end token")
            raw, at = ids.tobytes(), 0
            for w, end in zip(new, ends):
                words[w] = raw[at:end]
                at = end
        for c, w in zip(plain, lower):
            known[c] = words[w]
        for c, ws in zip(rest, cut):
            known[c] = b"".join([words[w] for w in ws])

    def by_marks(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        ids = np.array(self.whole(f" {self.MARK} ".join(c.decode() for c in chunks)), "<u4")
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(cuts) != len(chunks) - 1:
            raise ValueError("a chunk without a zero byte holds the mark's token")
        raw, at = ids.tobytes(), 0
        for c, end in zip(chunks, [*(4 * cuts).tolist(), 4 * len(ids)]):
            self.known[c] = raw[at:end]
            at = end + 4

    @staticmethod
    def folded(text: bytes) -> bytes:
        """A-Z read as a-z, as the normaliser does in the end, unless a special string or a combining mark may depend on it."""
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()

    def block(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text of a block."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.folded(t).split() for t in texts]
        flat = list(chain.from_iterable(split))
        ids = list(map(self.known.get, flat))
        unknown = [k for k, x in enumerate(ids) if x is None]
        once = self.learn({flat[k] for k in unknown})
        for k in unknown:
            c = flat[k]
            ids[k] = once[c] if c in once else self.known[c]
        ends = accumulate(map(len, split))
        return [b"".join(ids[end - len(chunks):end]) for chunks, end in zip(split, ends)]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _segments(path: str, end_id: int, segment_ids: int):
    """mapInArrow function: sorted (doc_id, text) rows to segment rows."""

    def run(batches):
        encode, part, end = encoder(path), TaskContext.get().partitionId(), np.uint32(end_id).astype("<u4").tobytes()
        number, start = 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        n = 0

        def done():
            nonlocal number, start, doc_ids, held, n
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(h) // 4 for h in held], np.uint64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([len(held)], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([simple8b.encode(lengths)], pa.binary()), pa.array([simple8b.encode(ids)], pa.binary())],
                names=["part", "segment", "start", "n_ids", "n_docs", "doc_ids", "lengths", "ids"])
            number, start = number + 1, start + len(ids)
            doc_ids, held, n = [], [], 0
            return out

        with uncollected(encode.forget):
            for batch in batches:
                column = batch.column(1).cast(pa.binary()).fill_null(b"")
                _, offs = utf8(column)
                for i, j in block_ranges(offs, BLOCK_BYTES):
                    rows = batch.column(0).slice(i, j - i).to_pylist()
                    for doc_id, ids in zip(rows, encode.block(column.slice(i, j - i).to_pylist())):
                        if held and n + len(ids) // 4 + 1 > segment_ids:
                            yield done()
                        doc_ids.append(doc_id), held.append(ids + end)
                        n += len(ids) // 4 + 1
            if held:
                yield done()

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None, segment_ids: int = SEGMENT_IDS) -> str:
    """Write the ids of all documents by ascending doc_id; returns the folder (by default one in the shared checkpoint folder)."""
    folder = folder or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    keyed = id_and_text(docs).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "row"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_segments(path, end_id, segment_ids), SEGMENTS).write.parquet(folder)
    return folder


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(folder)


def part_bases(segments: DataFrame) -> DataFrame:
    """part and base: the ids of all parts before it (one row per writing task)."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                part, start, doc_ids, lengths, ids = (b.column(c)[k] for c in range(5))
                n = simple8b.decode(lengths.as_py()).astype(np.int64)
                raw = simple8b.decode(ids.as_py()).astype("<u4").tobytes()
                at = np.append(0, np.cumsum(n))
                crcs = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(np.full(len(n), part.as_py(), np.int32)), pa.array(start.as_py() + at[:-1]), pa.array(n),
                     pa.array(crcs, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    segments = read_segments(spark, folder)
    found = segments.select("part", "start", "doc_ids", "lengths", "ids").mapInArrow(
        run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return (found.join(F.broadcast(part_bases(segments)), "part")  # one row per writing task
            .select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))


def read_ids(spark: SparkSession, folder: str, first: int, count: int) -> DataFrame:
    """position and id of the ids first .. first + count - 1 of the whole stream; only the blocks that hold them are decoded."""
    segments = read_segments(spark, folder)
    placed = segments.join(F.broadcast(part_bases(segments)), "part").withColumn("at", F.col("base") + F.col("start"))
    wanted = placed.where((F.col("at") < first + count) & (F.col("at") + F.col("n_ids") > first)).select("at", "n_ids", "ids")

    def run(batches):
        for b in batches:
            for at, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                lo, hi = max(first - at, 0), min(first + count - at, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + lo, at + hi)), pa.array(simple8b.decode(ids, lo, hi - lo).astype(np.int64))],
                                                 names=["position", "id"])

    return wanted.mapInArrow(run, "position long, id long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)
