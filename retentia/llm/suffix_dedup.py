"""Operator 2: removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a ``LENGTH``-byte string that covers it starts earlier too
(smaller doc_id, or the same document and an earlier start).

*The method* (``merge_shards``). Each shard of strings is suffix-sorted on its
own, which gives its Burrows-Wheeler transform. The transforms are merged by
refining an interleave: it says, for each place of the merged order, which shard
the next row comes from; step h sorts it by first h symbols, by a stable
distribution of the merged symbols, as the LF mapping does. Places where rows
first differ at step h are where common prefixes of length h end; after
``LENGTH`` steps the intervals without such a place are the strings that occur
repeatedly. No suffix is compared or sorted again in the merge.

*Spreading it.* Each LENGTH-byte window belongs to the anchor with the smallest
hash among its ``ANCHOR``-byte strings; equal windows have equal anchors. A
*segment* is the run of a text's windows with one anchor. So

1. equal segments are collapsed, first in each block of texts, then by anchor: of
   each, only the earliest occurrence goes on; the others repeat it as a whole. Both
   steps belong to one scan: a second one may cut the texts into other blocks;
2. among different segments of one anchor, those that share the core of a quarter
   of their windows go on: the rest can hold no repeated window;
3. what is left is a small part of the corpus. It is dealt by anchor, and each
   task merges the transforms of its shards.

Defined results: null and empty texts have 0 bytes, no spans, and the hash of the
empty string; a text below LENGTH bytes is kept whole; overlaps inside a text
count; a null doc_id counts as one smaller than all others; rows that share a doc_id,
or have none, are documents of their own, in the order in which the rows were
numbered (once, before anything else), so the first of them keeps what all hold;
spans belong to that number, never to a doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import textarrays as ta
from retentia.llm.common import id_and_text, map_blocks, materialize, read_table, shuffle_partitions, utf8
from retentia.llm.language_model import bucket_of

LENGTH = 100
ANCHOR = 16
SPREAD = LENGTH - ANCHOR + 1  # anchors of a window
BLOCK = 1 << 20
SHARD = 128 << 10
#: Bytes that a task merges at once (whole anchors only).
MERGED = 1 << 20
#: Low bits that hold a place; ``pieces_of`` keeps every place below.
POSITION = np.uint64((1 << 28) - 1)
#: Quarters of a window's possible anchor places, and the core that all windows of a quarter share.
LOW = np.array([0, 22, 43, 64])
HIGH = np.array([21, 42, 63, SPREAD - 1])
FIRST_ID = -(1 << 63)


class Segments:
    """Segments of a block of texts: row, start in the row, windows, anchor offset, anchor hash, digest, core hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        if n < LENGTH:
            self.row = self.start = self.windows = self.offset = np.empty(0, np.int64)
            self.anchor = self.digest = np.empty(0, np.uint64)
            self.cores = np.empty((0, 4), np.uint16)
            return
        p, inv = ta.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(ta.BYTE_VALUE[buf] * p[:-1], out=total[1:])
        span = lambda s, e: ta.mix((total[e] - total[s]) * inv[s])
        gram = ta.mix((total[ANCHOR:] - total[:-ANCHOR]) * inv[:n - ANCHOR + 1])
        # the leftmost smallest anchor of each window, as hash and place in one number
        least, k = (gram & ~POSITION) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * k <= SPREAD:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[:len(least) - (SPREAD - k)], least[SPREAD - k:])
        step = np.zeros(n + 1, np.int64)
        long = np.diff(offs) >= LENGTH
        np.add.at(step, offs[:-1][long], 1)
        np.add.at(step, offs[1:][long] - LENGTH + 1, -1)
        valid = np.cumsum(step)[:len(least)] > 0
        differs = least[1:] != least[:-1]
        # the last windows of a text are invalid, so runs never cross texts
        first = np.flatnonzero(valid & np.append(True, differs | ~valid[:-1]))
        last = np.flatnonzero(valid & np.append(differs | ~valid[1:], True))
        at = (least[first] & POSITION).astype(np.int64)
        self.row = np.searchsorted(offs, first, "right") - 1
        self.start, self.windows, self.offset = first - offs[self.row], last - first + 1, at - first
        # chosen for small hashes, anchors are hashed anew to spread evenly
        self.anchor, self.digest = ta.mix(gram[at] + ta.MIX[1]), span(first, last + LENGTH)
        self.cores = np.zeros((len(first), 4), np.uint16)
        for q in range(4):
            on = np.flatnonzero(present(self.offset, self.windows, q))
            self.cores[on, q] = (span(at[on] - LOW[q], at[on] - HIGH[q] + LENGTH) >> np.uint64(48)).astype(np.uint16)


def pieces_of(buf: np.ndarray, offs: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, Segments]]:
    """Segments of a block of texts; those of one text beyond the limit come piece by piece, each after the place its starts count from."""
    limit = limit or BLOCK
    if len(offs) > 2 or len(buf) <= limit:
        yield 0, Segments(buf, offs)
        return
    for a in range(0, len(buf) - LENGTH + 1, limit):
        piece = buf[a:a + limit + LENGTH - 1]
        yield a, Segments(piece, np.array([0, len(piece)]))


def present(offset: np.ndarray, windows: np.ndarray, q: int) -> np.ndarray:
    """Whether a segment has windows of quarter q."""
    return (offset >= LOW[q]) & (offset - windows + 1 <= HIGH[q])


def earliest(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest occurrence of each segment, and of those that come after it."""
    key = ta.pair_hash(anchor, digest)
    order = np.lexsort((start, row, doc, key))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])[:len(k)]
    return order[new], order[~new]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).fill_null(FIRST_ID)).astype(np.int64)


FIELDS = (("anchor", np.uint64), ("digest", np.uint64), ("doc", np.int64), ("row", np.int64), ("start", np.uint32), ("windows", np.uint8), ("offset", np.uint8), ("cores", np.uint16))


def anchor_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket and binary columns: each block's distinct segments, by anchor, and a share of the spans (row, start, end) that repeat one of them."""

    def dealt(s: Segments, at: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        values = {"anchor": s.anchor, "digest": s.digest, "doc": ids[s.row], "row": rows[s.row], "start": s.start + at, "windows": s.windows,
                  "offset": s.offset, "cores": s.cores}
        kept, later = earliest(s.anchor, s.digest, values["doc"], values["row"], s.start)
        repeats = joined_repeats(s, np.sort(later))
        repeats = np.stack([rows[repeats[:, 0]], repeats[:, 1] + at, repeats[:, 2] + at], 1)
        kept = kept[np.argsort(s.anchor[kept], kind="stable")]
        bucket = bucket_of(s.anchor[kept], buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *(pa.array([values[f][kept[cuts[k]:cuts[k + 1]]].astype(t).tobytes() for k in used], pa.binary()) for f, t in FIELDS),
             pa.array([r.tobytes() for r in np.array_split(repeats, len(used))], pa.binary())],
            names=["bucket", *(f for f, _ in FIELDS), "repeats"])

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = ids_of(batch), np.asarray(batch.column(2)).astype(np.int64)
        for at, s in pieces_of(*utf8(batch.column(1))):
            if len(s.row):
                yield dealt(s, at, ids, rows)

    return map_blocks(texts, "bucket int, " + ", ".join(f"{f} binary" for f, _ in FIELDS) + ", repeats binary", block, BLOCK)


def joined_repeats(s: Segments, later: np.ndarray) -> np.ndarray:
    """(row in the block, start, end) of the runs that the segments ``later`` (in text order) cover."""
    row, start, end = s.row[later], s.start[later], s.start[later] + s.windows[later] + LENGTH - 1
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > end[:-1]))[:len(later)]
    last = np.append(new[1:], True)[:len(later)]
    return np.stack([row[new], start[new], end[last]], 1)


FOUND = "anchor long, doc long, row long, start long, windows long, skip long, wanted long"


def candidates(rows: DataFrame, buckets: int) -> DataFrame:
    """Later occurrences of segments (anchor null: start, windows), and segments that may share windows with different ones."""

    def meet(bucket_rows):
        v = {f: np.concatenate([np.frombuffer(r[f], t) for r in bucket_rows]) for f, t in FIELDS}
        cores = v["cores"].reshape(-1, 4)
        doc, row, start = v["doc"], v["row"], v["start"].astype(np.int64)
        windows, offset = v["windows"].astype(np.int64), v["offset"].astype(np.int64)
        kept, later = earliest(v["anchor"], v["digest"], doc, row, start)
        repeats = np.concatenate([np.frombuffer(r["repeats"], np.int64) for r in bucket_rows]).reshape(-1, 3)
        whole = [np.concatenate(x) for x in ((row[later], repeats[:, 0]), (start[later], repeats[:, 1]), (windows[later], repeats[:, 2] - repeats[:, 1] - LENGTH + 1))]
        none = pa.array([None] * len(whole[0]), pa.int64())
        if len(none):
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in whole), none, none], names=[f.split()[0] for f in FOUND.split(", ")])
        possible = np.zeros((len(kept), 4), bool)
        for q in range(4):
            on = np.flatnonzero(present(offset[kept], windows[kept], q))
            key = ta.pair_hash(v["anchor"][kept[on]], cores[kept[on], q].astype(np.uint64), 7 + q)
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            possible[on[n[at] > 1], q] = True
        some = possible.any(1)
        kept, possible = kept[some], possible[some]
        if len(kept):
            high = np.minimum(HIGH[3 - possible[:, ::-1].argmax(1)], offset[kept])
            low = np.maximum(LOW[possible.argmax(1)], offset[kept] - windows[kept] + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v["anchor"][kept].view(np.int64)), pa.array(doc[kept]), pa.array(row[kept]), pa.array(start[kept]),
                 pa.array(windows[kept]), pa.array(offset[kept] - high), pa.array(high - low + 1)],
                names=[f.split()[0] for f in FOUND.split(", ")])

    def run(batches):
        bucket, got = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["bucket"] != bucket and got:
                    yield from meet(got)
                    got = []
                bucket = r["bucket"]
                got.append(r)
        if got:
            yield from meet(got)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of a shard sorted by what follows, up to LENGTH bytes and never beyond ``left`` bytes (prefix doubling)."""
    rank, k = text.astype(np.int64) + 1, 1
    while k < LENGTH:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:]
        ahead[left <= k] = 0
        values, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        rank += 1
        if len(values) == len(rank):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def merge_shards(strings: list[bytes], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, interval) of every LENGTH-byte window, in merged order; equal windows share an interval.

    Only rows that lead to a window are refined: after step h these are the
    positions with at least h bytes after them and LENGTH - h before them, and the
    LF mapping takes those of one step to those of the next one by one.
    """
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(strings), np.uint8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[of] - np.arange(len(text))  # bytes from a position to its string's end
    cuts = [0]
    for e in ends:
        if e - cuts[-1] >= shard or e == ends[-1]:
            cuts.append(int(e))
    # each shard's rows in its own suffix order, one shard after the other, and the shard's transform
    order = np.concatenate([a + suffix_order(text[a:b], left[a:b]) for a, b in zip(cuts, cuts[1:])])
    before = sizes[of] - left
    shard_of = np.searchsorted(cuts, order, "right") - 1
    kind = np.uint8 if len(cuts) < 256 else np.int32
    shard_of = shard_of.astype(kind)
    # distances beyond LENGTH are all alike
    rows_before, rows_left = (np.minimum(x[order], LENGTH).astype(np.uint8) for x in (before, left))
    transform = text[order - 1]
    transform[rows_before == 0] = 0
    # step 0: positions with LENGTH bytes before them; the end of a string counts, its symbol is the string's last byte
    window_count = int(np.maximum(sizes - LENGTH + 1, 0).sum())
    long = np.flatnonzero(sizes >= LENGTH)
    tails = np.array([], np.int64)
    interleave = np.array([], kind)
    interval = np.zeros(window_count, np.int64)
    for h in range(LENGTH):
        on = np.flatnonzero((rows_before >= LENGTH - h) & (rows_left >= max(h, 1)))
        shards, symbols = shard_of[on], transform[on]
        if h == 0:
            # the empty suffix of each string, before all others of its shard
            tails = np.searchsorted(cuts, ends[long] - 1, "right") - 1
            order0 = np.argsort(np.concatenate([tails, shards]), kind="stable")
            symbols = np.concatenate([text[ends[long] - 1], symbols])[order0]
            interleave = np.concatenate([tails, shards])[order0].astype(kind)
        else:
            # the merged sequence of symbols: each shard's own, in the order of the interleave
            merged = np.empty(len(symbols), np.uint8)
            merged[np.argsort(interleave, kind="stable")] = symbols
            symbols = merged
        to = np.argsort(symbols, kind="stable")
        parts, ordered = interval[to], symbols[to]
        interval = np.cumsum(np.append(False, (parts[1:] != parts[:-1]) | (ordered[1:] != ordered[:-1]))) if len(to) else interval
        interleave = interleave[to]
    on = rows_left >= LENGTH
    windows = order[on]
    place = np.empty(len(windows), np.int64)
    place[np.argsort(interleave, kind="stable")] = windows
    return of[place], before[place], interval


def repeated_windows(segments: DataFrame, buckets: int) -> DataFrame:
    """row, start, end of the windows of (anchor, doc, row, start, bytes) that an earlier segment holds too."""

    def merged(group):
        doc, row, start = (np.array([g[k] for g in group]) for k in (1, 2, 3))
        string, at, interval = merge_shards([g[4] for g in group])
        where, begin = row[string], start[string] + at
        order = np.lexsort((begin, where, doc[string], interval))
        new = np.append(True, interval[order][1:] != interval[order][:-1])
        later = order[~new]  # a window belongs to one segment, so each place comes once
        if not len(later):
            return None
        w, b = where[later], begin[later]
        o = np.lexsort((b, w))
        w, b = w[o], b[o]
        starts = np.append(True, (w[1:] != w[:-1]) | (b[1:] > b[:-1] + 1))
        last = np.append(np.flatnonzero(starts)[1:] - 1, len(b) - 1)
        return pa.RecordBatch.from_arrays([pa.array(w[starts]), pa.array(b[starts]), pa.array(b[last] + LENGTH)], names=["row", "start", "end"])

    def run(batches):
        group, size, anchor = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if row[0] != anchor and size >= MERGED:
                    if (out := merged(group)) is not None:
                        yield out
                    group, size = [], 0
                anchor = row[0]
                group.append(row)
                size += len(row[4])
        if group and (out := merged(group)) is not None:
            yield out

    ordered = segments.repartition(buckets, "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "row long, start long, end long")


def compressed(texts: DataFrame) -> DataFrame:
    """doc_id, row, z (compressed bytes)."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(batch.column(1))
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([z.compress(buf[a:b].tobytes()) for a, b in zip(offs, offs[1:])], pa.binary())],
            names=["doc_id", "row", "z"])

    return map_blocks(texts, "doc_id long, row long, z binary", block, BLOCK)


def wanted_segments(texts: DataFrame, found: DataFrame) -> DataFrame:
    """anchor, doc, row, start, bytes of the candidates."""
    wanted = found.where("anchor IS NOT NULL").groupBy("row").agg(
        F.collect_list(F.struct("anchor", "doc", "start", "skip", "wanted")).alias("wanted"))  # within one text

    def extract(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            offs, w = struct_lists(b, "wanted")
            at = w["start"] + w["skip"]
            to = at + w["wanted"] + LENGTH - 1
            for i, row in enumerate(b.column(0).to_pylist()):
                text = z.decompress(b.column(1)[i].as_py())
                k = slice(offs[i], offs[i + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w["anchor"][k]), pa.array(w["doc"][k]), pa.array(np.full(offs[i + 1] - offs[i], row), pa.int64()), pa.array(at[k]),
                     pa.array([text[x:y] for x, y in zip(at[k].tolist(), to[k].tolist())], pa.binary())], names=["anchor", "doc", "row", "start", "bytes"])

    long = compressed(texts.where(F.octet_length("text") >= LENGTH)).drop("doc_id")
    return long.join(wanted, "row").mapInArrow(extract, "anchor long, doc long, row long, start long, bytes binary")


def struct_lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of structs of longs; a null list is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.append(0, np.cumsum(sizes)), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by (start, end) rows."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def removed_spans(texts: DataFrame) -> DataFrame:
    """row, start, end of repeated strings of (doc_id, text, row)."""
    buckets = shuffle_partitions(texts.sparkSession)
    found = materialize(candidates(anchor_rows(texts, buckets), buckets), "segments")
    whole = found.where("anchor IS NULL").select("row", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))
    return whole.unionAll(repeated_windows(wanted_segments(texts, found), buckets))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every text."""
    texts = materialize(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    spans = removed_spans(texts).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # within one text

    def finish(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            offs, found = struct_lists(b, "spans")
            found = np.stack([found["start"], found["end"]], 1)
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                text = z.decompress(b.column(1)[i].as_py())
                gone = joined_spans(found[offs[i]:offs[i + 1]])
                kept = b"".join(text[a:e] for a, e in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(text)]))
                rows.append((doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            for k in range(0, len(rows), 256):
                cols = list(zip(*rows[k:k + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = compressed(texts).join(spans, "row", "left").select("doc_id", "z", "spans")
    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents")).drop("kept")
