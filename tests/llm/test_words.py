import random

import numpy as np
import public_tokenizers
import pytest

from ticketlens.llm import words

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def texts():
    rnd = random.Random(5)
    pool = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'S", "''", "'", " ", "  ", "\n", "\n\n", "\t", "a", "B", "cd", "É", "ñ",
            "ß", "12", "3", "!", "!?", "...", "don't", "x'sam", "i'll", " 'tis", "\xa0", "\x85", "\x1c", "\x0b", "²", "½", "’", "—",
            "漢字", "İ", "Ж", "😀", "é", "<|endoftext|>", "<|startoftext|>", "<|", "ſ", "ǅ", " ", "ﬁ"]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    out += ["", " ", "   ", "a", "hello world  foo", "x" * 5000, "word " * 3000] + [chr(c) + "a " + chr(c) + "1" + chr(c) for c in range(0x250)]
    return out


@pytest.mark.parametrize("name", FILES)
def test_same_ids_as_the_tokenizer(name):
    table = words.WordTable(public_tokenizers.path(name))
    docs = texts()
    ids, counts = table.encode(docs)
    at = 0
    for d, n in zip(docs, counts.tolist()):
        assert ids[at:at + n].tolist() == table.plain(d), repr(d)
        at += n
    assert at == len(ids)


def test_long_text_in_pieces(monkeypatch):
    table = words.WordTable(public_tokenizers.path(FILES[0]))
    monkeypatch.setattr(words, "BLOCK", 50)
    text = " ".join(["don't stop  now,", "12 ", "x's\n"] * 200)
    ids, counts = table.encode(["a", text, "", "b"])
    assert ids.tolist() == table.plain("a") + table.plain(text) + table.plain("b")
    assert counts.tolist()[2] == 0 and counts.sum() == len(ids)


def test_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(words, "MAX_WORDS", 5)
    table = words.WordTable(public_tokenizers.path(FILES[0]))
    for t in ("one two three", "four five six seven eight", "one two"):
        ids, _ = table.encode([t])
        assert ids.tolist() == table.plain(t)


def test_given_words_are_not_encoded_again():
    table = words.WordTable(public_tokenizers.path(FILES[0]))
    table.load([" made", "up"], [[1, 2], [3]])
    assert table.encode(["up made"])[0].tolist() == [3, 1, 2]
    assert np.array_equal(table.encode([""])[1], [0])
