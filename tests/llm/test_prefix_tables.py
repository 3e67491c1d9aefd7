"""Tables of pre-tokens that share their first bytes, against the library."""

import public_tokenizers
from tokenizers import Tokenizer

from retentia.llm.byte_bpe import Vocabulary
from retentia.llm.token_counts import STEM, PrefixCounter

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["tokenize", "tokenizers", "tokeniz", "tokeni", "token", "tokenisation", " tokenize", " tokenisers", "naïveté", "naïvetés",
         "000000", "0000000000", "zzzzzzzz", "zzzzzzq", "日本語", "日本酒蔵", "\U0001f600\U0001f600\U0001f601"]


def test_every_prefix_of_shared_stems():
    library, shared = Tokenizer.from_file(PATH), PrefixCounter(Vocabulary(PATH))
    for order in (WORDS, WORDS[::-1], WORDS):
        shared.tables.clear()
        for word in order:
            for piece in shared.vocabulary.pattern.findall(word):
                counts, at = shared.prefixes(piece.encode()), 0
                assert counts[0] == 0 and len(counts) == len(piece.encode()) + 1
                for k, char in enumerate(piece, 1):
                    at += len(char.encode())
                    if shared.vocabulary.pattern.findall(piece[:k]) == [piece[:k]]:
                        assert counts[at] == len(library.encode(piece[:k], add_special_tokens=False).ids)
    assert all(len(stem) == STEM and len(c) == STEM + 1 for stem, (_, c) in shared.stems.items())
