"""Each operator against a brute-force version, and on awkward and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF01, SF001
from retentia.llm import (decontamination, jaccard_join, langid, language_model, packing, quality_rules, secrets,
                          suffix_dedup, token_counts, toxicity)

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, node string, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and columns named like results."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "de"), (6, "one", "de"),
            (7, "one two", "de"), (8, long, "de"), (None, "no id at all here", None), (9, base.upper(), "en"), (10, base + "end", "en"),
            (11, "Été   \U0001f600 x" * 30, "fr"), (12, "a" * 5000, "fr"), (13, "password = abcdefgh12345 " + "f" * 40, "en")]
    return spark.createDataFrame([(i, t, g, "s", 0, "x", 0.0) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_quality_rules_and_ablation(spark, awkward, empty):
    book = quality_rules.ledger(awkward)
    got = {r["doc_id"]: r for r in quality_rules.apply_policy(book, "v1").collect()}
    for i, t in texts(awkward):
        words = t.encode().split()
        grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        n = Counter(grams)
        covered = {p for k, g in enumerate(grams) if n[g] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert got[i]["word_chars"] == sum(len(w.decode()) for w in words)
    a = {r["rule"]: r for r in quality_rules.ablations(book, "v1").collect()}
    bits = [r["fail_bits"] & quality_rules.POLICIES["v1"] for r in book.collect()]
    for k, name in enumerate(quality_rules.RULE_NAMES[:5]):
        assert a[name]["n_failed"] == sum(b >> k & 1 for b in bits)
        assert a[name]["n_only"] == sum(b == 1 << k for b in bits)
        assert a[name]["n_kept_without"] == sum(not b & ~(1 << k) for b in bits)
    assert quality_rules.ledger(empty).count() == 0


def brute_removed(docs):
    """Text kept and spans removed, by looking every window up."""
    seen: dict[bytes, tuple[int, int]] = {}
    order = sorted({(suffix_dedup.FIRST_ID if i is None else i, t.encode()) for i, t in docs})
    for i, t in order:
        for k in range(len(t) - 99):
            seen.setdefault(t[k:k + 100], (i, k))
    out = {}
    for i, t in order:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if seen[t[k:k + 100]] != (i, k):
                gone[k:k + 100] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check_dedup(df):
    want = brute_removed(texts(df))
    for r in suffix_dedup.deduplicate(df).collect():
        key = suffix_dedup.FIRST_ID if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[key], r["doc_id"]


def test_suffix_dedup(spark, awkward, empty):
    check_dedup(awkward.where("doc_id IS NULL OR doc_id <> 8"))
    assert suffix_dedup.deduplicate(empty).count() == 0
    rng = random.Random(2)
    part = ["".join(rng.choices("abcd ", k=n)) for n in (95, 100, 130, 260)]
    docs = [(i, "".join(rng.choice(part) if rng.random() < 0.5 else "".join(rng.choices("abcd ", k=rng.randint(1, 150))) for _ in range(6)))
            for i in range(60)]
    check_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))


def test_suffix_dedup_tells_rows_apart_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(3))
    docs = [(None, a + a), (None, b + b[:10]), (7, c), (7, c[:150] + a[:50] + c), (7, b), (8, c)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    # in the order of the rows: a text's second half, nothing, nothing, all but 50 bytes of a cut copy, all, all
    want = [(None, 800, 400), (None, 410, 0), (7, 400, 0), (7, 600, 550), (7, 400, 400), (8, 400, 400)]
    got = suffix_dedup.deduplicate(df)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "n_bytes", "n_removed").collect()))) == sorted(map(repr, want))


def test_suffix_dedup_of_texts_beyond_a_block(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choices("abcd ", k=9000))
    docs = [(1, base), (2, base[:4000] + "x" + base[3000:]), (3, "y" + base), (4, base[2000:2120] * 30)]
    whole = suffix_dedup.pieces_of
    monkeypatch.setattr(suffix_dedup, "pieces_of", lambda buf, offs: whole(buf, offs, 1000))
    buf = np.frombuffer(base.encode(), np.uint8)
    pieces = list(suffix_dedup.pieces_of(buf, np.array([0, len(buf)])))
    assert len(pieces) == 9 and sum(int(s.windows.sum()) for _, s in pieces) == len(base) - 99
    for d in docs:  # each text in a block of its own
        out = [at for at, _ in suffix_dedup.pieces_of(np.frombuffer(d[1].encode(), np.uint8), np.array([0, len(d[1])]))]
        assert out == list(range(0, len(d[1]) - 99, 1000))
    check_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))


def test_merge_of_transforms_sorts_windows():
    rng = random.Random(3)
    base = bytes(rng.choices(b"ab", k=400))
    strings = [base[k:k + rng.randint(90, 180)] for k in rng.choices(range(200), k=80)]
    string, start, interval = suffix_dedup.merge_shards(strings, shard=700)
    windows = [strings[s][a:a + 100] for s, a in zip(string, start)]
    assert windows == sorted(windows) and len(windows) == sum(max(0, len(s) - 99) for s in strings)
    assert [a == b for a, b in zip(windows, windows[1:])] == (np.diff(interval) == 0).tolist()


def test_language_model(spark, awkward, empty):
    for df in (awkward, spark.read.parquet(f"{SF001}/documents.parquet")):
        tokens = [(i, [*t.encode().lower().split(), None]) for i, t in texts(df)]
        c = Counter()
        for i, t in tokens:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
                c.update(t)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, len(t), sum(w in c for w in t), n) for i, t in tokens), key=repr)
        out = language_model.language_scores(df)
        assert rows(out.select("doc_id", "n_tokens", "n_known", "train_tokens")) == want
        base = dict((i, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens)
        got = out.collect()
        assert all(abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(base[r["doc_id"]])) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert language_model.language_scores(empty).count() == 0


def test_filter_never_loses_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    n = rng.integers(1, 200, 5000)
    bucket = language_model.bucket_of(keys, 4)
    parts = {k: language_model.filter_part(keys[bucket == k].astype(np.uint32), n[bucket == k], 1 << 20) for k in range(4)}
    got = language_model.LogFrequencyFilter(parts, 4).counts(keys)
    assert (got >= 2.0 ** np.floor(np.log2(n)) * 0.99).all() and np.median(got / n) < 1.5


def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    hit = [got[i]["predicted"] == t for i, t in marked.items() if not got[i]["held_out"]]
    assert len(got) == docs.count() and np.mean(hit) > 0.97
    none = toxicity.train(awkward, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.scores(awkward, none).collect())
    assert toxicity.scores(empty, none).count() == 0


def test_factors_learn_pairs():
    """Neither term alone is toxic; both together are."""
    rng = np.random.default_rng(5)
    data = [(int(a), int(b)) for a, b in rng.integers(0, 2, (600, 2))]
    feats = [np.array([x for x, on in ((3, a), (7, b), (int(rng.integers(10, 30)), 1)) if on], np.int32) for a, b in data]
    y = np.array([a * b for a, b in data], np.float32)
    model = toxicity.FactorizationMachine(64).fit(feats, y, epochs=60, factor_rate=0.1, decay=0.0)
    linear = toxicity.FactorizationMachine(64)
    linear.w, linear.b = model.w, model.b
    assert ((model.score(feats) >= 0.5) == y).mean() > 0.98
    assert model.v[3] @ model.v[7] > 1


def test_packing(spark, awkward, empty):
    encode = Tokenizer.from_file(PATH).encode
    ids = {}
    for i, t in texts(awkward):
        ids[i] = [*encode(t, add_special_tokens=False).ids, 2]
    for capacity in (64, 1024):
        got = packing.pack(packing.materialize(packing.pieces(awkward, PATH, capacity), "t"), capacity).collect()
        bins: dict = {}
        for r in got:
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
            assert r["length"] == capacity or r["piece"] == 0
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in texts(awkward))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= capacity
    assert packing.pack(packing.materialize(packing.pieces(empty, PATH), "t")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_minimum_bin_slack(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(40)}
    patterns = packing.minimum_bin_slack(counts, 100)
    used = Counter()
    for copies, uses in patterns:
        assert sum(n * u for n, u in uses.items()) <= 100
        used.update({n: copies * u for n, u in uses.items()})
    assert used == Counter(counts)
    bins = []  # first fit decreasing
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = next((k for k, left in enumerate(bins) if left >= n), None)
        if k is None:
            bins.append(100 - n)
        else:
            bins[k] -= n
    assert sum(c for c, _ in patterns) <= len(bins)


def test_secrets(spark, awkward, empty):
    import re
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    ratio = secrets.train(docs)
    for df in (docs, awkward):
        for r in secrets.scan(df, ratio).join(df.select("doc_id", "text"), "doc_id").collect():
            want = []
            for k, (p, ok) in enumerate((
                    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
                    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", lambda m: len(m[0]) >= 32))):
                want += [(m.start(), k, m.end()) for m in re.finditer(p, r["text"] or "", re.A) if ok(m)]
            assert r["base_sha256"] == hashlib.sha256(secrets.listed(want).encode()).hexdigest()
            assert set(secrets.listed(want).split(",")) <= set(r["spans"].split(","))
    assert secrets.scan(empty, ratio).count() == 0
    rng = random.Random(1)
    strong = ["".join(rng.choices(secrets.CHARS[:62], k=32)) for _ in range(100)]
    plain = ["informationretrievalthe", "get_user_name_by_identifier", "andthisotherthingnation", "internationalisationen"]
    assert sum(bool(secrets.random_spans(s, ratio, [])) for s in strong) >= 95
    assert not any(secrets.random_spans(s, ratio, []) for s in plain)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(awkward, ratio).collect()}
    assert masked[13] == "[SECRET] [SECRET]" and masked[3] is None and masked[6] == "one"


def brute_components(docs, size=3, num=90, den=100):
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_join(spark, awkward, empty):
    rng = random.Random(7)
    docs, words = [], [f"w{k}" for k in range(3000)]
    for g in range(25):
        base = rng.choices(words, k=rng.choice([9, 11, 12, 14, 22, 30, 31, 60, 120]))
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                if rng.random() < 0.5:
                    t.insert(rng.choice([0, len(t)]), rng.choice(words))
                else:
                    t[rng.choice([0, 1, len(t) - 1])] = rng.choice(words)
            docs.append((len(docs), " ".join(t)))
    for df in (spark.createDataFrame(docs, "doc_id long, text string"), awkward.where("doc_id IS NOT NULL")):
        want = brute_components(texts(df))
        got = jaccard_join.jaccard_components(df).collect()
        assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got) and len(got) == df.count()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 5, 80, 100)
    got = jaccard_join.jaccard_components(df, jaccard_join.Rule(5, 80, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert jaccard_join.jaccard_components(awkward).count() == awkward.count()
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_language_id(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(awkward, model).collect()}
    assert odd[3] == odd[4] == odd[5] == "und" and odd[6] != "und"
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, None).collect()} == {"und"}


def test_gradient():
    """Back-propagation through time against finite differences."""
    rng = np.random.default_rng(0)
    g = langid.Gru(rng, 3)
    for k in ("table", "u", "c"):
        setattr(g, k, getattr(g, k).astype(np.float64))
    x, weight = rng.integers(97, 100, (5, 2)), rng.normal(size=(5, 2, 3))
    grads = g.back(x, g.run(x, True)[1], weight)
    for name, at in (("u", (1, 4)), ("c", (2, 0)), ("table", (98, 7))):
        p, loss = getattr(g, name), []
        for step in (1e-3, -2e-3):
            p[at] += step
            loss.append(float((g.run(x) * weight).sum()))
        p[at] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - grads[name][at]) < 1e-2


def test_decontamination(spark, awkward, empty):
    import re
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "one two"), (3, None), (4, "never seen words"), (2, "one two"),
             (None, "one"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {}
    for r in decontamination.decontaminate(awkward, bench).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in texts(awkward):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            s = split(text)
            n = min(len(s), 10)
            for k in range(len(s) - n + 1 if n and item is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p] == s[k] and w[p:p + n] == s[k:k + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        for r in got[i]:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(awkward, none).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty, bench).count() == 0


def test_token_counts(spark, awkward, empty):
    t = Tokenizer.from_file(PATH)
    got = rows(token_counts.token_counts(awkward, PATH, 512))
    assert got == sorted(((i, len(x.encode()), n, n > 512) for i, x in texts(awkward) for n in [len(t.encode(x, add_special_tokens=False).ids)]), key=repr)
    assert token_counts.token_counts(empty, PATH, 512).count() == 0
    c = token_counts.counter(PATH)
    for x in ("a<|endoftext|>b", "  x  y \n\n z ", "we'll don't 12345 éè", " ", "tab\t\t x"):
        assert c.total(x) == len(t.encode(x, add_special_tokens=False).ids)
    text = "It's  a   test: we'll été unbelievably\n\n  longer 123456?! "
    table = c.table(text)
    counts = [len(t.encode(text[:e], add_special_tokens=False).ids) for e in range(len(text) + 1)]
    assert [table.count(e) for e in range(len(text) + 1)] == counts
    assert counts[table.longest_within(7)] <= 7


def test_pipeline(spark, awkward):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF001)
    want = brute_components(texts(docs), 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF001)
    bad = {r["doc_id"] for r in decontamination.op9_decontamination(spark, SF001).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts(docs)} - bad
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, SF001).columns == awkward.columns
    assert corpus_pipeline.run(spark, SF001).count() > 0


def test_pruning_sample_can_show_more_than_a_partner_may_lack():
    for rule in (jaccard_join.RULE, jaccard_join.Rule(5, 80, 100), jaccard_join.Rule(2, 1, 2), jaccard_join.Rule(3, 99, 100)):
        n = 30_000
        assert n // rule.sample > 1.5 * rule.can_miss(n)
