"""Simple-8b coding and the files of operator 13, by exact round trips and against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from retentia.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [0, 1, 2, 9, 255, 50_000, 2**33, 2**60 - 1, 2**60, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 4000):
        values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        values[rng.random(n) < 0.5] = 0
        stream = simple8b.encode(values)
        assert simple8b.size(stream) == n and (simple8b.decode(stream) == values).all()
        for first, count in ((0, 0), (0, n // 2), (n // 3, n // 2), (n - n // 4, n // 4)):
            assert (simple8b.decode(stream, first, count) == values[first:first + count]).all()


def test_simple8b_words_pack_as_many_values_as_fit():
    """A greedy coder written value by value gives the same words."""
    rng = np.random.default_rng(5)
    values = [int(v) for v in (rng.zipf(1.3, 3000) % 70_000)] + [2**61, 3, 2**64 - 1]
    words, escapes = [], []
    for b in range(0, len(values), simple8b.BLOCK):
        block, i = values[b:b + simple8b.BLOCK], 0
        while i < len(block):
            for s in range(1, len(simple8b.COUNT)):
                take = block[i:i + simple8b.COUNT[s]]
                if all(v < 1 << int(simple8b.WIDTH[s]) for v in take):
                    words.append(s << 60 | sum(v << k * int(simple8b.WIDTH[s]) for k, v in enumerate(take)))
                    i += len(take)
                    break
            else:
                words.append(0), escapes.append(block[i])
                i += 1
    stream = simple8b.encode(np.array(values, np.uint64))
    assert stream.endswith(np.array(words + escapes, "<u8").tobytes())
    with pytest.raises(IndexError):
        simple8b.decode(stream, 0, len(values) + 1)
    with pytest.raises(ValueError):
        simple8b.decode(b"none" + stream)


def wanted(rows):
    """start, n and crc by the library, over rows in order."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = wanted(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(map(tuple, token_files.op13_token_files(spark, SF001).collect())) == want


def test_awkward_rows_small_segments_and_random_access(spark):
    rng = random.Random(3)
    words = ["alpha", "Été", "don't", "x y", "é", "<|endoftext|>", "a<|startoftext|>b", "\0", "q\0r", "ΣΑΣ", "İ", "　", "\x1c", "\x85z", "12ab!?", "\U0001f600"]
    texts = [None, "", " \n\t ", *words, " ".join(words), "\n".join(words), "z" * 5000, " ".join(rng.choices(words, k=40_000))]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = token_files.write_token_files(docs, PATH, segment_ids=50)
    want = wanted([(None, "no id"), *((i, t) for i, t, _ in rows[:-1])])
    got = sorted(map(tuple, token_files.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.read_segments(spark, folder).where("n_ids > 50 AND n_docs > 1").count() == 0
    total = sum(r[2] for r in want)
    library = Tokenizer.from_file(PATH)
    stream = [i for _, t in [(None, "no id"), *((i, t) for i, t, _ in rows[:-1])] for i in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
    for first, count in ((0, 7), (total - 9, 9), (total // 2 - 2000, 3000)):
        assert [r["id"] for r in token_files.read_ids(spark, folder, first, count).orderBy("position").collect()] == stream[first:first + count]


def test_repeated_rows_shared_ids_and_empty_tables(spark):
    rows = [(5, "same text")] * 300 + [(5, "other text"), (4, "before"), (6, "after")]
    folder = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH)
    got = sorted(map(tuple, token_files.read_documents(spark, folder).collect()), key=lambda r: r[1])
    at = 0
    for doc_id, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == [4, *[5] * 301, 6]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in wanted(rows))
    empty = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert token_files.read_documents(spark, empty).count() == 0
