"""Operator 12 against a brute-force alignment, and the monoid's laws at random cuts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF001
from retentia.llm import alignment
from retentia.llm.byte_bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens):
    at = 0
    for t, raw in tokens:
        at += len(raw)
        yield t, at


def brute(docs, libraries):
    """Rows of the contract, text by text and link by link."""
    a, b = libraries
    alphabet = byte_alphabet()
    found, linked = [], Counter()
    for doc_id, text in docs:
        raw = (" " + (text or "")).encode()
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)] if text else []
        if b"".join(r for _, r in x) != raw or b"".join(r for _, r in y) != raw:
            found.append((doc_id, 0, 0, [], ""))
            continue
        x, y = list(ends(x)), list(ends(y))
        by_end: dict[int, list[int]] = {}
        for p, e in x:
            by_end.setdefault(e, []).append(p)
        links = [(p, q) for q, f in y for p in by_end.get(f, [])]
        common = sorted(set(by_end) & {f for _, f in y})
        groups = []
        i = j = 0
        for c in common:
            p, q = [], []
            while i < len(x) and x[i][1] <= c:
                p.append(str(x[i][0]))
                i += 1
            while j < len(y) and y[j][1] <= c:
                q.append(str(y[j][0]))
                j += 1
            groups.append(",".join(p) + "|" + ",".join(q))
        linked.update(links)
        found.append((doc_id, len(x), len(y), links, ";".join(groups)))
    best: dict[int, int] = {}
    for (_, q), n in linked.items():
        best[q] = max(best.get(q, 0), n)
    return sorted([(i, n_a, n_b, text.count(";") + 1 if text else 0, len(links), sum(linked[k] == best[k[1]] for k in links),
                    sum(linked[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for i, n_a, n_b, links, text in found], key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents_of_the_table(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert rows(alignment.op12_alignment(spark, SF001)) == brute(docs, libraries)


AWKWARD = [None, "", " ", "a", " a", "a ", "a  b", "\n a", "a \n b", "tab\t x", "Été   \U0001f600 x", "nul\0 x", "▁under", "x ▁ y", "good ▁", "<|endoftext|> <s> <unk> <0x41>",
           "　x 　 y", "a \x1c b", "z" * 3000, "日本語 テキスト です 東京", "1234567 89", "don't we'll", "é ́x", "https://example.org/a?b=c&d=e  x", "no break  y"]


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_awkward_texts_whole_and_in_ranges(spark, libraries, chunk):
    rng = random.Random(chunk)
    docs = list(enumerate(AWKWARD)) + [(100, " ".join(rng.choices([t for t in AWKWARD if t and "▁" not in t and len(t) < 99], k=600))), (None, "no id here"), (1, "shared id"), (1, "shared id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_a int").repartition(3)
    assert rows(alignment.align(df, A, B, chunk, 3)) == brute(docs, libraries)


def test_long_texts_by_rounds_of_folds(spark, libraries):
    rng = random.Random(9)
    words = ["the", "alignment", "tokenization", "Été", "naïve", "x1y2", "\U0001f600", "und", "\n", ""]
    docs = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((20_000, 5, 7_000, 0, 2_000))] + [(9, "q" * 4000), (10, "ok " * 3000 + "▁ " * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(alignment.align(df, A, B, 1000, 4)) == brute(docs, libraries)


def test_any_cut_gives_the_same_groups():
    """Ranges at random bytes, folded in random trees."""
    align, rng = alignment.aligner(A, B), random.Random(2)
    for text in [t for t in AWKWARD if t and "▁" not in t] + [" ".join(AWKWARD[3:12])]:
        raw = (" " + text).encode()
        good, whole, _, _ = alignment.range_fragment(align, 0, len(raw), 0, raw)
        assert good
        for _ in range(4):
            size = rng.randint(1, max(2, len(raw) // 2))
            if len(raw) > 1000:
                size = max(size, 200)
            parts = [alignment.range_fragment(align, low, high, begin, context) for low, high, begin, context in alignment.cut_ranges(raw, size)]
            fragments = [p[1] for p in parts]
            while len(fragments) > 1:
                k = rng.randrange(len(fragments) - 1)
                fragments[k:k + 2] = [alignment.compose(fragments[k], fragments[k + 1])]
            assert alignment.whole_text(fragments[0]) == alignment.whole_text(whole)
            assert b"".join(t.tobytes() for p in parts for t in p[2][:1]) == alignment.range_fragment(align, 0, len(raw), 0, raw)[2].a.tobytes()
            assert sum(len(p[3]) for p in parts) == alignment.whole_text(whole)[0]
            assert alignment.whole_text(alignment.fold(p[1] for p in parts)) == alignment.whole_text(whole)
    assert alignment.compose(alignment.EMPTY, whole) == whole == alignment.compose(whole, alignment.EMPTY)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
