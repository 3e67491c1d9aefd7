"""Operator 7: n-gram Jaccard self-join, size-aware (light and heavy sets).

A document is the set of its distinct shingles (``Rule``: words per shingle, and the
similarity as a fraction); two link when den * |A & B| >= num * |A | B|. Copies share
one set, so sets (*nodes*) are joined, not documents.

1. *Pruning.* A set may lack at most n - ceil(num n / den) elements of any partner's.
   Elements that no other set holds can be counted on a hash sample of the
   elements, kept alike in all sets: a set with more unmatched sampled elements
   than that has no partner. Only the rest is joined.
2. *Light sets* (n <= boundary) enumerate all subsets of the fixed sizes
   ceil(num n / den) .. n. The intersection of a linked pair is such a subset of both.
   Within a subset's group a pair links by sizes alone, and if it does, both link
   with the group's smallest set: one edge per member keeps all components.
3. *Heavy sets* scan inverted lists of their necessary prefix, their first elements
   in one order of all elements. Any one order is right; rare elements first keeps the
   lists short, and how rare an element is is read from a table of ``CELLS`` counters,
   so that no set's other elements are ever shuffled.
   a. *Stars.* Each list names one of its sets its hub (by hash, so that lists of the
      same sets agree), and every other set of the list is compared with it: by size,
      by parity bitmaps, which bound the difference from below, and exactly. What links
      is contracted; a second round takes other hubs.
   b. *Scan.* Lists whose sets still lie in several components are compared pair by
      pair, two blocks at a time, first by place and bitmaps. A pair counts in the list of
      its first common element only: all its common elements come from there on, so if
      less than a link needs is left of either set, the pair is none or another list's. A task returns the closest
      pairs that would connect components, fewer than it has sets; they are verified
      and contracted. What may still link by its bitmaps is then compared by its
      elements, and a task returns only links between sets that its own links have not
      connected yet: again fewer rows than sets, however many of them link.
4. The boundary is the one that minimises subsets plus prefix postings over the
   histogram of set sizes.

Links inside a component need not all be listed: the result carries components.

Defined results: null, empty and blank texts have an empty set, size 0, and are
their own component; fewer words than a shingle are one shingle; copies and repeated
rows share a component; rows with a null doc_id link like others, and their component
is the smallest doc_id it reaches (null if it reaches none). Only doc_id and text are
read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import textarrays as ta
from retentia.llm.common import freed_shuffles, id_and_text, id_array, map_blocks, materialize, read_table, released, text_array, utf8
from retentia.llm.components import connected_components


class Rule(NamedTuple):
    """Words per shingle, and the least similarity num / den of a link."""

    shingle: int = 3
    num: int = 90
    den: int = 100

    def can_miss(self, n):
        """Elements of an n-set that may be missing from a partner."""
        return n - (self.num * n + self.den - 1) // self.den

    def can_miss_sql(self, n: str):
        return F.expr(f"{n} - ((({self.num} * {n}) + {self.den - 1}) div {self.den})")

    @property
    def sample(self):
        """One element in this many is in the pruning sample: enough of a set that more can be unmatched there than a partner may lack."""
        return max(1, 3 * self.den // (5 * (self.den - self.num))) if self.num < self.den else 1

    def common(self, both):
        """Least number of common elements of a linked pair with ``both`` elements in its two sets together."""
        return -(-self.num * both // (self.num + self.den))

    def common_sql(self, both: str):
        return F.expr(f"({self.num} * ({both}) + {self.num + self.den - 1}) div {self.num + self.den}")

    def most_apart(self, both):
        """Largest symmetric difference of a linked pair with ``both`` elements in its two sets together."""
        return both - 2 * self.common(both)


RULE = Rule()
#: Largest set that may count as light, by the number of subsets.
MAX_LIGHT = 29
#: Counters of the table of element frequencies.
CELLS = 1 << 20
#: Bits of the filter that keeps texts without a chosen set out of the shuffle: 2 MB, whatever the table's size.
FILTER = 1 << 24
#: Sets, and elements, of one block of a list that is scanned.
BLOCK, BLOCK_ELEMENTS = 2048, 400_000
STARS = 2
#: A list names its open pairs if they are at most this many times its sets, else its open sets.
PAIRS = 2
BITS = (64, 4096)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z read as a-z)."""
    starts, ends, first = ta.word_spans(buf, offs)
    words = ta.span_hashes(buf, starts, ends, ta.LOWER_VALUE)
    grams, at = ta.ngram_hashes(words, first, shingle)
    g_first = np.searchsorted(at, first)
    out = []
    for i in range(len(offs) - 1):
        n = first[i + 1] - first[i]
        if n >= shingle:
            g = np.sort(grams[g_first[i]:g_first[i + 1]])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif n:  # a shorter text is one shingle
            h = words[first[i]:first[i] + 1]
            for k in range(first[i] + 1, first[i + 1]):
                h = ta.pair_hash(h, words[k:k + 1], 12)
            out.append(ta.pair_hash(h, h, 11))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    """64-bit name of a set."""
    total = np.uint64(np.sum(ta.mix(s * ta.MIX[0] + ta.MIX[1]))) if len(s) else np.uint64(0)
    return int(ta.pair_hash(np.array([total]), np.array([len(s)], np.uint64))[0].astype(np.int64))


def profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, content (a hash of the text), n, node and the sampled elements of each text."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*utf8(text_array(batch)), rule.shingle)
        sample = [s[s % np.uint64(rule.sample) == 0].view(np.int64) for s in sets]
        offsets = np.append(0, np.cumsum([len(x) for x in sample])).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [id_array(batch), batch.column(batch.schema.get_field_index("content")), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([digest(s) for s in sets], pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*sample, np.empty(0, np.int64)]), pa.int64()))],
            names=["doc_id", "content", "n", "node", "sample"])

    return map_blocks(id_and_text(docs, F.xxhash64(F.col("text").cast("string")).alias("content")),
                      "doc_id long, content long, n long, node long, sample array<long>", block)


def survivors(profiles: DataFrame, rule: Rule) -> DataFrame:
    """node, n and the rep (doc_id, content) of each set that may have a partner."""
    # an element is unmatched if all texts that hold it have one set; copies add nothing
    alone = (profiles.select("node", F.explode("sample").alias("element")).groupBy("element")
             .agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
             .groupBy("node").agg(F.count(F.lit(1)).alias("unmatched")))
    nodes = profiles.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("rep"), F.max("n").alias("n"))
    return (nodes.join(alone, "node", "left")
            .where(F.coalesce("unmatched", F.lit(0)) <= rule.can_miss_sql("n")).select("node", "rep", "n"))


def probably(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts whose ``content`` shares a filter bit with a chosen one: all that are chosen, and few others while those are few."""
    bit = F.pmod(F.col("content"), F.lit(FILTER))
    words = (chosen.select((F.pmod(F.col("rep.content"), F.lit(FILTER))).alias("bit"))
             .groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("ones")))
    marked = texts.withColumn("bit", bit).join(F.broadcast(words), F.expr("bit div 64") == F.col("word"))  # at most FILTER / 64 rows
    return marked.where("(shiftright(ones, cast(bit % 64 as int)) & 1) = 1").select(*texts.columns)


def sets_of(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """node, n, elements (sorted, as bytes) and bits (parity bitmap) of the chosen nodes."""
    texts = probably(id_and_text(docs).withColumn("content", F.xxhash64("text")), chosen).alias("t")
    reps = chosen.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.content").alias("rep_content"))
    mine = texts.join(reps, F.col("t.doc_id").eqNullSafe(F.col("rep_id")) & (F.col("t.content") == F.col("rep_content"))).select("node", "text")

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*utf8(text_array(batch)), rule.shingle)
        keep = [(node, s) for node, s in zip(batch.column(0).to_pylist(), sets) if digest(s) == node]  # not another text of that hash
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()),
             pa.array([s.tobytes() for _, s in keep], pa.binary()), pa.array([parity_bits(s, len(s)).tobytes() for _, s in keep], pa.binary())],
            names=["node", "n", "elements", "bits"])

    return map_blocks(mine, "node long, n long, elements binary, bits binary", block).dropDuplicates(["node"])


def subsets(n: int, rule: Rule = RULE) -> int:
    return sum(math.comb(n, k) for k in range(rule.can_miss(n) + 1))


def boundary(sizes: dict[int, int], rule: Rule = RULE) -> int:
    """Largest light size: subsets enumerated up to it, plus prefix postings (each compared with a hub) beyond it, are fewest."""
    costs = {}
    for x in range(0, MAX_LIGHT + 1):
        light = sum(c * subsets(n, rule) for n, c in sizes.items() if n <= x)
        heavy = sum(c * (rule.can_miss(n) + 1) for n, c in sizes.items() if n * rule.den > rule.num * x) * 2
        costs[x] = light + heavy
    return min(costs, key=lambda x: (costs[x], x))


def light_edges(sets: DataFrame, x: int, rule: Rule) -> DataFrame:
    """Edges among sets of at most x elements, by common subsets of a fixed size."""

    def enumerate_subsets(batches):
        from itertools import combinations

        for b in batches:
            keys, nodes, sizes, lengths = [], [], [], []
            for node, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hashed = ta.mix(np.frombuffer(raw, np.uint64) * ta.MIX[0] + ta.MIX[1])
                total = hashed.sum()
                for k in range(rule.can_miss(n) + 1):
                    for out in combinations(range(n), k):
                        h = total - hashed[list(out)].sum() if k else total
                        keys.append(int(ta.pair_hash(np.array([h]), np.array([n - k], np.uint64))[0].astype(np.int64)))
                        nodes.append(node), sizes.append(n), lengths.append(n - k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, nodes, sizes, lengths)], names=["key", "node", "n", "c"])

    rows = sets.where(F.col("n") <= x).select("node", "n", "elements").mapInArrow(released(enumerate_subsets), "key long, node long, n long, c long")
    # one of the smallest members is the hub of the group
    hub = rows.groupBy("key").agg(F.min(F.struct("n", "node")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return (rows.join(hub, "key").where(F.col("node") != F.col("hub.node"))
            .where(f"{rule.den} * c >= {rule.num} * (n + hub.n - c)").select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct())


def parity_bits(s: np.ndarray, n: int) -> np.ndarray:
    """Parity of the elements per hash cell: the Hamming distance of two such maps is at most the sets' difference."""
    size = min(max(BITS[0], 1 << (n - 1).bit_length()), BITS[1])
    ones = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each of ``CELLS`` cells: an upper estimate of an element's frequency."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total[np.frombuffer(raw, np.uint64) % np.uint64(CELLS)] += 1  # a set's elements seldom share a cell
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    found = sets.select("elements").mapInArrow(released(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.int64)
    table = found.toArrow()  # at most CELLS rows
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefix_postings(sets: DataFrame, x: int, rule: Rule) -> DataFrame:
    """element, node, n, rest: the necessary prefix of every set that can meet a heavy one; rest counts its elements from this one on."""
    table = sets.sparkSession.sparkContext.broadcast(frequencies(sets))  # CELLS counters, whatever the table's size

    def post(batches):
        for b in batches:
            elements, nodes, sizes = [], [], []
            for node, n, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = np.frombuffer(raw, np.uint64)
                rank = table.value[s % np.uint64(CELLS)]
                elements.append(s[np.lexsort((s, rank))[:rule.can_miss(n) + 1]].view(np.int64))
                nodes.append(node), sizes.append(n)
            if nodes:
                counts = [len(e) for e in elements]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(elements)), pa.array(np.repeat(np.array(nodes, np.int64), counts)),
                                                  pa.array(np.repeat(np.array(sizes, np.int64), counts)),
                                                  pa.array(np.concatenate([n - np.arange(c) for n, c in zip(sizes, counts)]))], names=["element", "node", "n", "rest"])

    heavy = sets.where(F.col("n") * rule.den >= F.lit(rule.num) * x).select("node", "n", "elements")
    return heavy.mapInArrow(released(post), "element long, node long, n long, rest long")


def useful(postings: DataFrame, rule: Rule) -> DataFrame:
    """The postings that can be the first common element of a linked pair.

    There the smaller set has enough elements left for a partner of its own size, and the
    larger one for a partner of the smallest such size in the list.
    """
    least = postings.where(F.col("rest") >= rule.common_sql("2 * n")).groupBy("element").agg(F.min("n").alias("least"))
    return postings.join(least, "element").where(F.col("rest") >= rule.common_sql("n + least")).drop("least")


def open_lists(postings: DataFrame, seed: int) -> DataFrame:
    """element, hub, blocks of the lists whose sets lie in several components."""
    lists = postings.groupBy("element").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("n").alias("elements"), F.count(F.lit(1)).alias("size"),
        F.min(F.struct(F.xxhash64("node", F.lit(seed)), F.col("node").alias("node"), F.col("n").alias("n"), F.col("comp").alias("comp"))).alias("hub"))
    return lists.where("c0 != c1").select("element", "hub", F.greatest(F.ceil(F.col("elements") / BLOCK_ELEMENTS), F.ceil(F.col("size") / BLOCK)).cast("int").alias("blocks"))


def star_candidates(postings: DataFrame, x: int, seed: int, rule: Rule) -> DataFrame:
    """Distinct (u, v), each list's hub and another set of the list, whose sizes allow a link."""
    both = postings.join(open_lists(postings, seed).select("element", "hub"), "element")
    low, high = F.least("n", "hub.n"), F.greatest("n", "hub.n")
    some = both.where((F.col("comp") != F.col("hub.comp")) & (high > x) & (low * rule.den >= high * rule.num))
    return some.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()


def close_enough(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose bitmaps do not rule a link out."""
    s = sets.select("node", "n", "bits")
    both = (pairs.join(s.withColumnsRenamed({"node": "u", "n": "nu", "bits": "bu"}), "u")
            .join(s.withColumnsRenamed({"node": "v", "n": "nv", "bits": "bv"}), "v").select("u", "v", "nu", "nv", "bu", "bv"))

    def check(batches):
        for b in batches:
            keep = []
            for n, m, p, q in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                w = min(len(p), len(q))
                keep.append(int(np.bitwise_count(folded(p, w) ^ folded(q, w)).sum()) <= rule.most_apart(n + m))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(released(check), "u long, v long")


def linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    merged = np.sort(np.concatenate([x, y]))
    common = int((merged[1:] == merged[:-1]).sum())
    return rule.den * common >= rule.num * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    s = sets.select("node", "elements")
    both = (pairs.join(s.withColumnsRenamed({"node": "u", "elements": "x"}), "u")
            .join(s.withColumnsRenamed({"node": "v", "elements": "y"}), "v").select("u", "v", "x", "y"))

    def check(batches):
        for b in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rule)
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(released(check), "u long, v long")


def block_links(nodes: list[int], comps: list[int], sides: list[int], raw: list[bytes], x: int, rule: Rule, rests: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among the sets of two blocks (or within one) that connect components, each component pair once.

    ``sides``: pairs within side 0, or between the sides where both occur. ``rests``: elements of each set from the list's on.
    """
    sets = [np.frombuffer(r, np.uint64) for r in raw]
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    n = np.array([len(sets[k]) for k in order])
    comp, side = np.array([comps[k] for k in order]), np.array([sides[k] for k in order])
    bits = np.array([parity_bits(sets[k], BITS[1]) for k in order])
    rest = n if rests is None else np.array([rests[k] for k in order])
    two, out = side.any(), []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, np.searchsorted(n, n[i] * rule.den // rule.num, "right"))
        j = j[(n[j] > x) & (comp[j] != comp[i])]
        if two:
            j = j[side[j] != side[i]]
        j = j[np.minimum(rest[j], rest[i]) >= rule.common(n[j] + n[i])]
        if not len(j):
            continue
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
        for k in j[apart <= rule.most_apart(n[j] + n[i])].tolist():
            if comp[k] != comp[i] and linked(sets[order[i]], sets[order[k]], rule):
                out.append((nodes[order[i]], nodes[order[k]]))
                comp[comp == comp[k]] = comp[i]
    return out


def bit_neighbours(n: np.ndarray, bits: list[np.ndarray], comp: np.ndarray, side: np.ndarray, x: int, rule: Rule, rest: np.ndarray | None = None):
    """(i, others, distances) of the pairs of a list that may link by size, place and bitmap; ``comp`` may change on the way. Rows go by n."""
    rest = n if rest is None else rest
    words = np.array([len(b) for b in bits])
    maps = {w: np.array([folded(b, w) for b in bits[int(np.searchsorted(words, w)):]]) for w in sorted(set(words.tolist()))}
    two = side.any()
    for i in range(len(n) - 1):
        j = np.arange(i + 1, np.searchsorted(n, n[i] * rule.den // rule.num, "right"))
        j = j[(n[j] > x) & (comp[j] != comp[i])]
        if two:
            j = j[side[j] != side[i]]
        j = j[np.minimum(rest[j], rest[i]) >= rule.common(n[j] + n[i])]
        if len(j):
            table = maps[int(words[i])]
            skip = len(n) - len(table)
            apart = np.bitwise_count(table[j - skip] ^ table[i - skip]).sum(1)
            near = apart <= rule.most_apart(n[j] + n[i])
            if near.any():
                yield i, j[near], apart[near]


def likely_links(n, bits, comp, side, x: int, rule: Rule, rest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that would connect all components that bitmaps let connect, the closest first: fewer than rows."""
    comp, out = comp.copy(), []
    for i, j, apart in bit_neighbours(n, bits, comp, side, x, rule, rest):
        j = j[np.argsort(apart, kind="stable")]
        _, first = np.unique(comp[j], return_index=True)
        for k in j[np.sort(first)].tolist():
            out.append((i, k))
            comp[comp == comp[k]] = comp[i]
    return out


def blocks_of_lists(postings: DataFrame) -> DataFrame:
    """element, a, b, side, node, n, comp, rest: the sets of lists in several components, in every pair of blocks they belong to."""
    postings = postings if "rest" in postings.columns else postings.withColumn("rest", F.col("n"))  # lists of whole sets
    cut = postings.join(open_lists(postings, 0).select("element", "blocks"), "element")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("element", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                      (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "comp", "rest")


def in_groups(df: DataFrame, schema: str, f) -> DataFrame:
    """``f`` of the rows (without the key) of each (element, a, b), one group in memory at a time; it returns columns or None."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    ordered = df.repartition("element", "a", "b").sortWithinPartitions("element", "a", "b", "n")

    def run(batches):
        key, group = None, []

        def done():
            out = f(key, group) if len(group) > 1 else None
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)] if out and len(out[0]) else []

        for b in batches:
            for e, p, q, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (e, p, q) != key:
                    if group:
                        yield from done()
                    key, group = (e, p, q), []
                group.append(row)
        if group:
            yield from done()

    return ordered.mapInArrow(released(run), schema)


def with_bits(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets.select("node", "bits"), "node").select("element", "a", "b", "side", "node", "n", "comp", "rest", "bits")


def _columns(group):
    side, node, n, comp, rest, raw = zip(*group)
    return node, np.array(rest), np.array(n), [np.frombuffer(r, np.uint64) for r in raw], np.array(comp), np.array(side)


def scan_candidates(postings: DataFrame, sets: DataFrame, x: int, rule: Rule) -> DataFrame:
    """Distinct (u, v): the closest pairs, by bitmaps, that would connect the components of each list."""

    def scan(_, group):
        node, rest, *columns = _columns(group)
        pairs = [(node[i], node[k]) for i, k in likely_links(*columns, x, rule, rest)]
        return [[min(p) for p in pairs], [max(p) for p in pairs]]

    return in_groups(with_bits(blocks_of_lists(postings), sets), "u long, v long", scan).distinct()


def scan_links(postings: DataFrame, sets: DataFrame, x: int, rule: Rule) -> DataFrame:
    """Links between components, from the sets of open lists that may still link by their bitmaps."""

    def members(key, group):
        node, rest, n, bits, comp, side = _columns(group)
        some, pairs = np.zeros(len(n), bool), []
        for i, j, _ in bit_neighbours(n, bits, comp, side, x, rule, rest):
            some[i] = some[j] = True
            if len(pairs) <= PAIRS * len(n):
                pairs += [(node[i], node[k]) for k in j.tolist()]
        if len(pairs) <= PAIRS * len(n):
            none = [0] * len(pairs)
            return [none, none, none, none, [min(p) for p in pairs], none, none, none, [max(p) for p in pairs]]
        at = np.flatnonzero(some).tolist()
        return [[key[0]] * len(at), [key[1]] * len(at), [key[2]] * len(at), [int(side[k]) for k in at], [node[k] for k in at],
                [int(n[k]) for k in at], [int(comp[k]) for k in at], [int(rest[k]) for k in at], pa.nulls(len(at), pa.int64())]

    left = materialize(in_groups(with_bits(blocks_of_lists(postings), sets),
                                 "element long, a long, b long, side long, node long, n long, comp long, rest long, other long", members), "open")
    few = left.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()  # many lists name one pair
    whole = left.where("other IS NULL").join(sets.select("node", "elements"), "node").select("element", "a", "b", "side", "node", "n", "comp", "rest", "elements")

    def verify(_, group):
        side, node, _, comp, rest, raw = zip(*group)
        pairs = block_links(node, comp, side, raw, x, rule, rest)
        return [[min(p) for p in pairs], [max(p) for p in pairs]]

    return verified(few, sets, rule).unionAll(in_groups(whole, "u long, v long", verify))


def links(sets: DataFrame, rule: Rule) -> DataFrame:
    """Enough verified edges (u, v) between nodes to connect all that links connect."""
    sizes = {r["n"]: r["c"] for r in sets.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    x = boundary(sizes, rule)
    postings = materialize(useful(materialize(prefix_postings(sets, x, rule), "prefixes"), rule), "postings")
    found = materialize(light_edges(sets, x, rule), "links")

    def with_components() -> DataFrame:
        comps = connected_components(found)
        return postings.join(comps, "node", "left").select("element", "node", "n", "rest", F.coalesce("component", "node").alias("comp"))

    for seed in range(STARS):
        candidates = star_candidates(with_components(), x, seed, rule)
        found = materialize(found.unionAll(verified(close_enough(candidates, sets, rule), sets, rule)), "links")
    found = materialize(found.unionAll(verified(scan_candidates(with_components(), sets, x, rule), sets, rule)), "links")
    return materialize(found.unionAll(scan_links(with_components(), sets, x, rule)), "links")


def jaccard_components(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    with freed_shuffles(docs.sparkSession):
        profiles = materialize(profile(docs, rule), "profiles")
        chosen = materialize(survivors(profiles, rule), "survivors")
        sets = materialize(sets_of(docs, chosen, rule), "sets")
        comps = connected_components(links(sets, rule))
    nodes = profiles.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(comps, "node", "left")
    nodes = nodes.select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(smallest, "component").select("node", "component_id")
    return (profiles.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
