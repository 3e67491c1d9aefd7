"""Operator 11: ranked lexical search by branch and bound over a document FP-tree.

1. Each text is scanned once and restricted to the terms of the items: (term, tf)
   pairs and the number of all its terms, written as a table. N, L and the document
   frequencies are sums over that table.
2. Every task takes its share of the table in *shards* of bounded size. A shard's
   restricted vectors, their terms in descending document frequency, share the paths
   of a trie (chains of single children are one edge). Each node keeps the maximal tf
   of every term below it and the least m below it, so that the score formula, which
   grows with tf and falls with m, bounds every document of the subtree. A document
   is a leaf, whose bound is its score.
3. For each item the trie is searched depth first, children with the highest bounds
   first. A subtree whose bound cannot enter the best k is left; the best k of an item
   are carried from shard to shard of a task.
4. Each task returns k documents of each item, which Spark merges.

Items are taken in blocks of ``ITEMS``, so that what a task holds of them is bounded; each
block scans the texts once. Terms are matched by 64-bit hashes (the chance that
any of 10^11 words is mistaken for one of 10^4 terms is below 0.001).

Defined results: null texts and texts without terms are no documents; items without
terms, and null items, have no rows; rows of the benchmark that repeat item_id and text
are one item; repeated documents are ranked each on their own; documents without a
doc_id come last among equal scores; an empty table gives no rows. Only doc_id, text
and item_id are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm import textarrays as ta
from retentia.llm.common import id_and_text, id_array, map_blocks, materialize, read_table, text_array, utf8

TOP = 20
#: Items searched in one scan of the texts.
ITEMS = 4096
#: A shard is full at so many documents or (term, tf) pairs.
SHARD_DOCS, SHARD_PAIRS = 16_384, 600_000
#: A node of no more documents has them as its children; so has a node so many levels down.
LEAF, LEVELS = 48, 24

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Stands for a missing doc_id in the order of equal scores.
LAST = np.iinfo(np.int64).max


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().lower())


def term_hashes(terms: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms])
    return ta.span_hashes(buf, ends - [len(t) for t in terms], ends, ta.LOWER_VALUE)


def vectors(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), and the terms (index into ``hashes``, which is sorted) with their tf, of each text with a term."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, offs = utf8(text_array(batch))
        starts, ends, first = ta.word_spans(buf, offs, _INSIDE)
        if not len(starts):
            return None
        words, n = ta.span_hashes(buf, starts, ends, ta.LOWER_VALUE), np.diff(first)
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == words)
        row = ta.row_of(first, len(words))[hit]
        key, tf = np.unique(row * len(hashes) + at[hit], return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(n) + 1) * len(hashes)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % len(hashes), tf)]
        return pa.RecordBatch.from_arrays([id_array(batch), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return map_blocks(id_and_text(docs), "doc_id long, n long, terms array<int>, tfs array<int>", block)


class Tree:
    """The trie of a shard.

    ``lengths`` pairs of each document stand in ``terms`` (numbers by descending
    document frequency, ascending in a document) and ``tfs``.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        offs = np.append(0, np.cumsum(lengths))
        paths = [terms[a:b] for a, b in zip(offs[:-1], offs[1:])]
        names = [p.astype(">u4").tobytes() for p in paths]
        order = np.array(sorted(range(len(paths)), key=names.__getitem__), np.int64)
        self.ids, self.m = ids[order], m[order]
        shared = self.shared_prefixes([paths[k] for k in order])
        self.grow(shared)
        self.summarise(order, offs, terms, tfs)

    @staticmethod
    def shared_prefixes(paths: list[np.ndarray]) -> np.ndarray:
        """Terms that each path shares with the one before it."""
        out = np.zeros(len(paths), np.int64)
        for k in range(1, len(paths)):
            a, b = paths[k - 1], paths[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            out[k] = differ[0] if len(differ) else n
        return out

    def grow(self, shared: np.ndarray) -> None:
        """Nodes level by level: the documents ``low`` .. ``high`` - 1 of each, its parent and its children (numbers next to each other)."""
        low, high, parent, level = [0], [len(shared)], [-1], [0]
        first, last = [], []
        k = 0
        while k < len(low):
            a, b = low[k], high[k]
            first.append(len(low))
            if b - a > 1:
                if b - a <= LEAF or level[k] >= LEVELS:
                    cuts = list(range(a, b + 1))
                else:
                    inner = shared[a + 1:b]
                    cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
                low += cuts[:-1]
                high += cuts[1:]
                parent += [k] * (len(cuts) - 1)
                level += [level[k] + 1] * (len(cuts) - 1)
            last.append(len(low))
            k += 1
        self.low, self.high, self.parent, self.level = (np.array(x, np.int64) for x in (low, high, parent, level))
        self.first, self.last = first, last
        # the least m and the smallest id of each node's documents
        runs = np.stack([self.low, self.high], 1).ravel()
        self.least_m = np.minimum.reduceat(np.append(self.m, LAST), runs)[::2]
        self.least_id = np.minimum.reduceat(np.append(self.ids, LAST), runs)[::2]
        self.single = self.high - self.low == 1

    def summarise(self, order: np.ndarray, offs: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """(term, node) and the maximal tf below the node, sorted: from each level to the one above it."""
        nodes = len(self.low)
        found = []
        term, node, tf = (np.empty(0, np.int64) for _ in range(3))
        for level in range(int(self.level[-1]), -1, -1):
            own = np.flatnonzero((self.level == level) & self.single)
            docs = order[self.low[own]]
            n = offs[docs + 1] - offs[docs]
            at = np.repeat(offs[docs] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            key = np.concatenate([term * nodes + self.parent[node], terms[at].astype(np.int64) * nodes + np.repeat(own, n)])
            value = np.concatenate([tf, tfs[at]])
            by = np.argsort(key, kind="stable")
            key, value = key[by], value[by]
            if len(key):
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, value = key[starts], np.maximum.reduceat(value, starts)
            found.append((key, value))
            term, node, tf = key // nodes, key % nodes, value
        key, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        by = np.argsort(key, kind="stable")
        self.keys, self.tfs = key[by], value[by]

    def bounds(self, a: int, b: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The highest score that the documents below each of the nodes a .. b - 1 can have."""
        base = terms * len(self.low)
        lo, hi = np.searchsorted(self.keys, base + a), np.searchsorted(self.keys, base + b)
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        node = self.keys[at] - np.repeat(base, n)
        tf = self.tfs[at]
        part = 1_000_000_000 * tf // (1000 * tf + 12 * self.least_m[node])
        # exact: sums of integers far below 2 ** 53
        return np.bincount(node - a, weights=part * np.repeat(weights, n), minlength=b - a).astype(np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Enter the shard's documents into ``best``, the sorted (-score, doc_id) of an item; returns the number of nodes bounded."""
        if not len(self.low):
            return 0
        stack, seen = [], 1
        ends = self.bounds(0, 1, terms, weights)
        if self.single[0]:
            self.enter(np.array([0]), ends, best, k)
        else:
            stack.append((int(ends[0]), int(self.least_id[0]), 0))
        while stack:
            bound, smallest, node = stack.pop()
            if not self.may_enter(bound, smallest, best, k):
                continue
            a, b = self.first[node], self.last[node]
            ends = self.bounds(a, b, terms, weights)
            seen += b - a
            hope = np.flatnonzero(ends > 0 if len(best) < k else ends >= max(1, -best[-1][0]))
            leaf = self.single[a + hope]
            self.enter(a + hope[leaf], ends[hope[leaf]], best, k)
            inner = hope[~leaf]
            stack += sorted(zip(ends[inner].tolist(), (-self.least_id[a + inner]).tolist(), (a + inner).tolist()))
            if len(inner):
                stack[-len(inner):] = [(x, -y, z) for x, y, z in stack[-len(inner):]]
        return seen

    @staticmethod
    def may_enter(score: int, doc_id: int, best: list[tuple[int, int]], k: int) -> bool:
        return score > 0 and (len(best) < k or (-score, doc_id) <= best[-1])

    def enter(self, nodes: np.ndarray, scores: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        ids = self.least_id[nodes]
        by = np.lexsort((ids, -scores))[:k]
        new = [(-s, i) for s, i in zip(scores[by].tolist(), ids[by].tolist()) if s > 0]
        if new:
            best[:] = sorted(best + new)[:k]


def best_of_tasks(table: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """item, doc_id, score of each task's k best documents of each item.

    ``place`` gives a term's number by descending document frequency.
    """

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held, docs, pairs = [], 0, 0

        def search():
            ids, m, lengths, terms, tfs = (np.concatenate(x) for x in zip(*held))
            tree = Tree(ids, m, lengths, terms, tfs)
            for (t, w), found in zip(items, best):
                tree.search(t, w, found, k)

        for batch in batches:
            for part in pieces_of(batch, place):
                ids, n, lengths, terms, tfs = part
                held.append((ids, 75 + 25 * n * n_docs // all_terms, lengths, terms, tfs))
                docs, pairs = docs + len(ids), pairs + len(terms)
                if docs >= SHARD_DOCS or pairs >= SHARD_PAIRS:
                    search()
                    held, docs, pairs = [], 0, 0
        if docs:
            search()
        rows = [(i, None if d == LAST else d, -s) for i, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, "item int, doc_id long, score long")


def pieces_of(batch: pa.RecordBatch, place: np.ndarray):
    """(ids, n, lengths, terms, tfs) of the documents with a term of an item, a bounded number at a time; terms are placed and in order."""
    for at in range(0, batch.num_rows, 2048):
        rows = batch.slice(at, 2048)
        ids, n = rows.column(0).fill_null(LAST).to_numpy(), rows.column(1).to_numpy()
        lengths = np.diff(rows.column(2).offsets.to_numpy()).astype(np.int64)
        terms, tfs = place[rows.column(2).flatten().to_numpy()], rows.column(3).flatten().to_numpy().astype(np.int64)
        by = np.lexsort((terms, np.repeat(np.arange(len(ids)), lengths)))
        some = lengths > 0
        if some.any():
            yield ids[some], n[some], lengths[some], terms[by], tfs[by]


def search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for a bounded table of items."""
    spark = docs.sparkSession
    rows = [r for r in items.collect() if r["text"] and TERM.search(r["text"].encode())]  # at most a block of items
    found = [Counter(terms_of(r["text"])) for r in rows]
    vocabulary = sorted(set().union(*found))
    kind = items.schema["item_id"].dataType.simpleString()
    if not vocabulary:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    hashes = term_hashes(vocabulary)
    by_hash = np.argsort(hashes)
    table = materialize(vectors(docs, hashes[by_hash]), "term-vectors")
    n_docs, all_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the items' terms
        df[r["term"]] = r["count"]
    place = np.empty(len(vocabulary), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    number = {vocabulary[w]: x for x, w in enumerate(by_hash.tolist())}
    asked = []
    for counts in found:
        x = np.array([number[t] for t in counts], np.int64)
        by = np.argsort(place[x])
        asked.append((place[x][by], (weight[x] * np.array(list(counts.values()), np.int64))[by]))
    best = best_of_tasks(table, asked, place, n_docs, max(1, all_terms), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most a block of items


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    asked = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    blocks = -(-asked.count() // items)
    if blocks <= 1:
        return search_block(docs, asked, k)
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = None
    for b in range(blocks):
        part = search_block(docs, asked.where(F.col("block") == b).drop("block"), k)
        out = part if out is None else out.unionAll(part)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS all_docs, sum(n) AS all_terms FROM held),
items AS (SELECT row_number() OVER () AS k, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT k, item_id, term, count(*) AS uses FROM (SELECT k, item_id, unnest({_TERMS}) AS term FROM items) GROUP BY ALL),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
scores AS (
  SELECT k, item_id, r, sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN held USING (r), totals GROUP BY k, item_id, r),
ranked AS (
  SELECT k, item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN held USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
