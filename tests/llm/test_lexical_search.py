"""Operator 11 against brute force over all pairs of items and documents, and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest import SF01, SF001
from retentia.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        ranked = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                ranked.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def table(spark, data, schema):
    return spark.createDataFrame(data, schema).repartition(3)


def test_tables_and_sql(spark):
    got = rows(lexical_search.op11_lexical_search(spark, SF001))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert got == brute(docs, items)


def test_sql_on_more_documents(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF01}/{name}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.SQL})").fetchall()
    assert rows(lexical_search.op11_lexical_search(spark, SF01)) == sorted(want, key=repr)


@pytest.fixture(params=[(16_384, 600_000, 48, 24), (7, 50, 2, 3)])
def sizes(request, monkeypatch):
    for name, value in zip(("SHARD_DOCS", "SHARD_PAIRS", "LEAF", "LEVELS"), request.param):
        monkeypatch.setattr(lexical_search, name, value)


def test_random_documents_ties_and_copies(spark, sizes):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Été", "été", "X", "x"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)] + [(None, docs[7][1]), (None, None), (5, "w1 w1 w2"), (5, "w1 w1 w2"), (6, None), (7, ""), (8, " .,! \n")]
    docs += [(9, " ".join(rng.choices(words, k=20_000)))]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(100, docs[7][1]), (101, "w1 w1 w1"), (101, "w1 w1 w1"), (102, None), (103, ""), (104, "nowhere at all"), (105, "É été X"), (None, "w3 w4")]
    got = rows(lexical_search.search(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string")))
    assert got == brute(docs, [x for x in items if x[1]])


def test_blocks_of_items_and_clashing_columns(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=15)), 1, 2, 3) for i in range(80)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=4)), 1) for i in range(23)]
    got = rows(lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string, n int, score int, rank int"),
                                     spark.createDataFrame(items, "item_id string, text string, item int"), k=5, items=4))
    assert got == brute([d[:2] for d in docs], [x[:2] for x in items], 5)


def test_bounds_hold_and_prune():
    """No document beats its ancestors' bounds, and where documents have topics a search bounds less than half of the nodes."""
    rng = np.random.default_rng(13)
    n, v = 3000, 400
    topic, topics = rng.integers(0, 30, n), np.arange(v) % 30
    has = rng.random((n, v)) < np.where(topics == topic[:, None], 0.5, np.where(np.arange(v) < 3, 0.9, 0.001))
    has[:, 0] |= ~has.any(1)
    by = np.argsort(-has.sum(0), kind="stable")  # descending document frequency
    has, topics = has[:, by], topics[by]
    tf = rng.integers(1, 6, (n, v))
    lengths, m = has.sum(1), rng.integers(75, 200, n)
    ids = rng.permutation(n).astype(np.int64)
    tree = lexical_search.Tree(ids, m, lengths, np.nonzero(has)[1], tf[has])
    assert sorted(tree.ids.tolist()) == list(range(n)) and tree.single.sum() == n
    seen = 0
    for q in range(20):
        terms_ = np.flatnonzero((topics == q) | (np.arange(v) < 3))
        weights = np.maximum(1, (1000 * np.log(n / has[:, terms_].sum(0))).astype(np.int64))
        scores = (np.where(has, 10**9 * tf // (1000 * tf + 12 * m[:, None]), 0)[:, terms_] * weights).sum(1)
        bounds = tree.bounds(0, len(tree.low), terms_, weights)
        inner = np.flatnonzero(tree.parent >= 0)
        assert (bounds[inner] <= bounds[tree.parent[inner]]).all()
        assert dict(zip(tree.least_id[tree.single].tolist(), bounds[tree.single].tolist())) == dict(zip(ids.tolist(), scores.tolist()))
        best: list = []
        seen += tree.search(terms_, weights, best, 20)
        assert best == sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:20]
    assert seen < 0.5 * 20 * len(tree.low)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [r["doc_id"] for r in lexical_search.search(docs, items).collect()] in ([], [1])
