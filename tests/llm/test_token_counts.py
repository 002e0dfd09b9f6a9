import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "\t", "a", "re", "sb", "l", "é", "漢", "字", "23", "٣", "!", "?", ".", "\x85", "\xa0", "　", "😀", "\0", "\x1c", "<|endoftext|>", "ing", "\U000e0100", "Hello", "x" * 70, "é" * 40]


def texts(seed, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", "'", "a'", "it's", " 's", "l'll'll"]


def by_library(some):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch_fast(some, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_the_librarys(seed):
    some = texts(seed)
    assert token_counts.TokenCounter(PATH).counts(some).tolist() == by_library(some)


def test_spans_are_the_automatons():
    for some in (texts(7), ["plain it's ASCII ''s  'tis", "", "x 've"], [chr(x) + "a" for x in range(0x3100) if not 0xD800 <= x < 0xE000]):
        assert all(np.array_equal(a, b) for a, b in zip(token_counts.spans(some), bpe.boundaries(some)))


def test_new_pieces_are_merged_without_the_library(monkeypatch):
    """Its cost for each new piece took most of the time that op8 needed for lengths."""
    rng = random.Random(4)
    some = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 30))) for _ in range(200)) for _ in range(20)]
    counter, wanted = token_counts.TokenCounter(PATH), by_library(some)

    class Refuses:
        def __getattr__(self, name):
            raise AssertionError(f"the library was asked: {name}")

    monkeypatch.setattr(counter.library, "tokenizer", Refuses())
    assert counter.counts(some).tolist() == wanted == counter.counts(some).tolist()


def test_emptied_tables_and_long_texts(monkeypatch):
    monkeypatch.setattr(token_counts.CountTable, "LIMIT", 50)
    monkeypatch.setattr(token_counts.PieceTable, "RUN", 64)
    monkeypatch.setattr(token_counts, "RUN_CHARS", 100)
    some = texts(9, 300)
    assert token_counts.TokenCounter(PATH).counts(some).tolist() == by_library(some)


def test_other_models_are_left_to_the_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    counter, some = token_counts.TokenCounter(str(path)), texts(1, 100)
    assert counter.merges is None
    assert counter.counts(some).tolist() == [len(e.ids) for e in Tokenizer.from_file(str(path)).encode_batch_fast(some, add_special_tokens=False)]
