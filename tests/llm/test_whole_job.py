"""Cases that an operator once cut short, each against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from retentia.llm import decontamination, jaccard_join, language_model, secrets, suffix_dedup
from conftest import SF001
from test_operators import brute_components, brute_removed, texts


def test_jaccard_links_across_the_sample_size(spark):
    """Linked pairs with one set above 64 shingles and one below it."""
    rng = random.Random(64)
    docs = []
    for g in range(20):
        words = [f"g{g}w{k}" for k in range(rng.randint(66, 73) + 2)]
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(words[:rng.randint(62, 64) + 2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(texts(df))
    linked = {c for i, (_, c) in want.items() if c != i}
    assert len(linked) > 10 and all(want[i][0] > 64 for i in linked)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()} == want


def test_filter_grows_with_its_entries():
    """Five million level entries in one bucket (of 200, by the old cap, it had 40 KB): absent n-grams stay absent."""
    rng = np.random.default_rng(3)
    low = rng.permutation(np.unique(rng.integers(0, 2**32, 1_200_000, dtype=np.uint32)))
    held, absent = low[:1_000_000], low[1_000_000:]
    part = language_model.filter_part(held, np.full(len(held), 16))
    assert len(part) * 8 >= language_model.BITS * 5 * len(held)
    assert (language_model.LogFrequencyFilter({0: part}, 1).levels(absent.astype(np.uint64)) > 0).mean() < 0.02


def test_filter_is_measured_on_held_out_bigrams(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=200))) for i in range(200)], "doc_id long, text string")
    stored = language_model.materialize(language_model.blocks(df), "lm-blocks")
    answers = language_model.bigram_answers(language_model.bigram_rows(stored, 4), 4)
    rate = language_model.misread_rate(answers, "bigram")
    assert rate is not None and rate < 0.03


def test_dedup_when_later_scans_cut_other_blocks(spark, tmp_path):
    """Copies share a block while segments are found, and are apart when the result is read."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh ", k=600))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[50:400])], "doc_id long, text string")
    docs.repartition(3, "doc_id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    want = brute_removed(texts(df))
    conf = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert df.rdd.getNumPartitions() == 1
        out = suffix_dedup.deduplicate(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        got = out.collect()
    finally:
        for k in (*conf, "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(k)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_a_list_returns_fewer_links_than_sets():
    """Sets of which all link, or only neighbours, or none: what a block returns connects the same and stays linear."""
    rng, rule = np.random.default_rng(6), jaccard_join.RULE
    base = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
    for drift, linked in ((2, True), (60, False)):
        sets = [np.sort(np.append(base[drift:], rng.integers(0, 2**63, drift, dtype=np.uint64))) for _ in range(120)]
        pairs = jaccard_join.block_links(list(range(120)), list(range(120)), [0] * 120, [s.tobytes() for s in sets], 0, rule)
        assert len(pairs) == (119 if linked else 0)
        assert all(jaccard_join.linked(sets[u], sets[v], rule) for u, v in pairs)
    sides = [k % 2 for k in range(120)]
    sets = [np.sort(np.append(base[2:], rng.integers(0, 2**63, 2, dtype=np.uint64))) for _ in range(120)]
    pairs = jaccard_join.block_links(list(range(120)), list(range(120)), sides, [s.tobytes() for s in sets], 0, rule)
    assert len(pairs) == 119 and all(sides[u] != sides[v] for u, v in pairs)


def test_open_lists_are_scanned_by_bits_then_by_elements(spark):
    """One list of 30 sets in two families, none contracted yet: both scans connect each family and nothing else."""
    rng, rule = np.random.default_rng(7), jaccard_join.RULE
    families = [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(2)]
    sets = [np.sort(np.append(families[k % 2][1:], rng.integers(0, 2**63, 1, dtype=np.uint64))) for k in range(30)]
    table = spark.createDataFrame([(k, len(s), bytearray(s.tobytes()), bytearray(jaccard_join.parity_bits(s, len(s)).tobytes())) for k, s in enumerate(sets)],
                                  "node long, n long, elements binary, bits binary")
    postings = spark.createDataFrame([(5, k, len(s), k) for k, s in enumerate(sets)], "element long, node long, n long, comp long")
    for scan in (jaccard_join.scan_candidates, jaccard_join.scan_links):
        pairs = [tuple(r) for r in scan(postings, table, 0, rule).collect()]
        assert len(pairs) == 28 and all(u < v and u % 2 == v % 2 for u, v in pairs)


def test_jaccard_links_through_rows_without_id(spark):
    """Documents 1 and 3 link only with a text that no row with an id holds; so do texts that share one id."""
    words = [f"w{k}" for k in range(80)]
    texts_ = {1: words[:72], None: words[3:75], 3: words[6:78], 9: [f"x{k}" for k in range(80)]}
    rows_ = [(i, " ".join(t)) for i, t in texts_.items()] + [(9, " ".join(words[7:79])), (None, "alone here and now"), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(
        [(1, 1), (None, 1), (3, 1), (9, 9), (9, 1), (None, None), (None, None)], key=repr)


def test_near_copies_that_do_not_link(spark, monkeypatch):
    """A chain of texts of which only neighbours link, and a group of which none do, in blocks of few elements."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", 900)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[2 * k:2 * k + 60])) for k in range(40)]
    base = [f"b{k}" for k in range(60)]
    far = [(100 + k, " ".join(base[:40] + rng.choices(words, k=8) + base[40:])) for k in range(60)]
    df = spark.createDataFrame(chain + far, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(texts(df))
    assert {got[k][1] for k in range(40)} == {0} and len({got[100 + k][1] for k in range(60)}) == 60


def test_pipeline_rows_without_id_shared_ids_and_clashing_columns(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    one, near, other = " ".join(words), " ".join(words[2:] + ["x"]), " ".join(f"y{k}" for k in range(40))
    rows_ = [(7, one), (5, near), (5, other), (None, one), (None, "quite another text of its own"), (None, "quite another text of its own"), (8, None), (8, "")]
    columns = "__id string, __key string, __lang_pred string, __score int, row int, key int, number int, id int, seen_score int, component_id int, content int"
    docs = spark.createDataFrame([(*r, "en", "a", "b", "c", *range(8)) for r in rows_], f"doc_id long, text string, lang string, {columns}").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF001)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(5, near), (5, other), (None, "quite another text of its own"), (8, None), (8, "")], key=repr)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and out.where("__id = 'a'").count() == out.count()
        nothing = stage(spark, docs.limit(0), SF001)
        assert nothing.columns == docs.columns and nothing.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF001).count() == 0


def test_samples_keep_their_size_at_any_count(spark):
    """The share of a sample is met whether rows are many or pretended to be very many, and repeated rows add nothing."""
    from retentia.llm.common import hashed_share

    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    assert 1700 < docs.where(hashed_share(0.01)).count() < 2300
    assert docs.where(hashed_share(1.0)).count() == 200_000 and docs.where(hashed_share(0.0)).count() == 0
    assert docs.where(hashed_share(3e6 / 1e13)).count() <= 2  # a share below one in a million is not rounded up


def test_decontamination_numbers_rows_once(spark, tmp_path, monkeypatch):
    """More than one block of windows, and a scan that is cut differently after the first block."""
    items = [(k, " ".join(f"b{k}w{j}" for j in range(10))) for k in range(6)]
    docs = spark.createDataFrame([(k, f"x y {t} z") for k, t in items], "doc_id long, text string")
    docs.coalesce(1).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "docs"))
    real, conf = decontamination.materialize, {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}

    def changing(df, tag):
        out = real(df, tag)
        if tag == "contexts":
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return out

    monkeypatch.setattr(decontamination, "materialize", changing)
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = decontamination.decontaminate(spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        for k in (*conf, "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(k)
    assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(k, 10, 1, True) for k in range(6)]


def test_secrets_behind_a_base_span(spark):
    """Both parts of a run: the base span and the random string that goes on behind it."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    ratio, rng = secrets.train(docs), random.Random(8)
    found = 0
    for _ in range(40):
        for head in ("AKIA" + "".join(rng.choices(secrets.CHARS[:26], k=16)) + "/", "".join(rng.choices("0123456789abcdef", k=32)) + "-"):
            text = "x " + head + "".join(rng.choices(secrets.CHARS[:62], k=40)) + " y"
            base = secrets.base_spans(text)
            found += secrets.random_spans(text, ratio, base) == [(2 + len(head) - 1, 3, len(text) - 2)]
    assert found >= 76
    plain = "AKIA" + "A" * 16 + "/get_user_name_by_identifier"
    assert not secrets.random_spans(plain, ratio, secrets.base_spans(plain))
