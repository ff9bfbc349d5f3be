"""Splitting of whole texts into pre-token words with numpy, and a bounded word table.

A tokenizer of the BPE kind cuts a text into words by a fixed pattern and then
encodes each word by itself, so equal words have equal ids.  ``WordTable``
splits a block of texts at once, looks every word up in a table that encodes
each distinct word once, and joins the ids back by position.  Words are found
by a 64-bit hash and then compared character by character, so a collision
cannot change an id.  Texts with characters whose class the two libraries may
see differently, or with a special token's string, go through the tokenizer
whole; the result is the same.
"""
from __future__ import annotations

import json
import re

import numpy as np

from .common import BLOCK, runs, seeds, segments

_OTHER, _LETTER, _DIGIT, _SPACE = 0, 1, 2, 3
_TOP = 0x10000
_CUT = re.compile("[!-~¡-ɏ][ \n]")
_P = int(seeds(1, 11)[0])
_MIX = seeds(3, 12)
#: Distinct words a task's table may hold before it starts anew.
MAX_WORDS = 400_000

_tables: dict[tuple, "WordTable"] = {}


def table_for(path: str) -> "WordTable":
    """This worker process's table for a tokenizer file."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _classes(lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and safety of every character below 0x10000."""
    import regex

    cls, low, safe = np.zeros(_TOP, np.int8), np.arange(_TOP, dtype=np.uint32), np.zeros(_TOP, bool)
    spans = [(0, 0x250), (0x2010, 0x2028), (0x4E00, 0x9FA6)] + ([] if lower else [(0x400, 0x460)])
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for a, b in spans:
        for c in range(a, b):
            s = chr(c)
            cls[c] = _LETTER if letter.match(s) else _DIGIT if digit.match(s) else _OTHER
            safe[c] = True
            if lower:
                t = s.lower()
                if len(t) == 1 and any(x <= ord(t) < y for x, y in spans):
                    low[c] = ord(t)
                else:
                    safe[c] = False
    cls[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return cls, low, safe


class WordTable:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spaced = spec["normalizer"] is None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cls, self.low, self.safe = _classes(not self.spaced)
        self.to_model = _byte_letters()
        self.given = None
        self.clear()

    def clear(self) -> None:
        """Drop all words but the given ones."""
        if self.given is not None:
            self.__dict__.update(self.given)
            return
        self.keys = np.zeros(0, np.uint64)      # sorted word hashes
        self.rows = np.zeros(0, np.int32)       # their rows below
        self.c_start, self.c_len = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.i_start, self.i_len = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.chars, self.ids = np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    def _grow(self, keys: np.ndarray, words: list[np.ndarray], ids: list[list[int]]) -> None:
        n = len(self.c_start)
        c_len, i_len = np.array([len(w) for w in words], np.int32), np.array([len(i) for i in ids], np.int32)
        self.c_start = np.concatenate([self.c_start, (len(self.chars) + np.cumsum(c_len) - c_len).astype(np.int32)])
        self.i_start = np.concatenate([self.i_start, (len(self.ids) + np.cumsum(i_len) - i_len).astype(np.int32)])
        self.c_len, self.i_len = np.concatenate([self.c_len, c_len]), np.concatenate([self.i_len, i_len])
        self.chars = np.concatenate([self.chars, np.concatenate(words).astype(np.uint16)])  # words of safe characters
        self.ids = np.concatenate([self.ids, np.fromiter((x for i in ids for x in i), np.uint32, int(i_len.sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], np.concatenate([self.rows, np.arange(n, n + len(words), dtype=np.int32)])[order]

    def load(self, words: list[str], ids: list[list[int]]) -> None:
        """Take over words whose ids are known already (those of a word table made by Spark)."""
        self.take(packed_words(words, np.fromiter((x for i in ids for x in i), np.uint32), np.array([len(i) for i in ids])))

    def take(self, packed: dict[str, np.ndarray]) -> None:
        """The same for words that are packed already; the arrays are used as they are."""
        self.given = packed
        self.clear()

    def word_ids(self, words: list[np.ndarray]) -> list[list[int]]:
        """Ids of each word (its characters), as the tokenizer's model gives them."""
        flat = np.concatenate(words)
        wide = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800)
        upto = np.concatenate([[0], np.cumsum(wide)])[np.cumsum([len(w) for w in words])].tolist()
        text = flat.tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.to_model)
        tokenize, out, at = self.tokenizer.model.tokenize, [], 0
        for stop in upto:
            out.append([t.id for t in tokenize(text[at:stop])])
            at = stop
        return out

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for part in self._parts(texts):
            got, lens = part
            ids.append(got)
            np.add.at(counts, lens[0], lens[1])
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), counts

    def count_words(self, texts: list[str], longest: int) -> dict[str, int]:
        """How often each distinct word of at most ``longest`` characters occurs (texts that go
        through the tokenizer whole are left out)."""
        texts = [t for t in texts if not any(s in t for s in self.special)]
        lens = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return {}
        unsafe = (chars >= _TOP) | ~self.safe[np.minimum(chars, _TOP - 1)]
        if unsafe.any():
            odd = np.zeros(len(texts), bool)
            odd[np.searchsorted(np.cumsum(lens), np.flatnonzero(unsafe), side="right")] = True
            return self.count_words([t for t, o in zip(texts, odd) if not o], longest)
        if not self.spaced:
            chars = self.low[chars]
        start, end = split(chars, lens, self.cls, self.spaced)
        short = end - start <= longest
        start, end = start[short], end[short]
        if not len(start):
            return {}
        _, first, n = np.unique(_hashes(chars, start, end), return_index=True, return_counts=True)
        text = chars.tobytes().decode("utf-32-le")
        return dict(zip((text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())), n.tolist()))

    def _parts(self, texts: list[str]):
        """(ids, (row, number of ids)) of blocks of whole texts or of pieces of long ones."""
        sizes = np.array([len(t) for t in texts], np.int64)
        for a, b in runs(sizes):
            block, rows = texts[a:b], np.arange(a, b)
            if b == a + 1 and len(block[0]) > 2 * BLOCK and not any(s in block[0] for s in self.special):
                for piece in _pieces(block[0]):
                    yield self._block([piece], rows)
            else:
                yield self._block(block, rows)

    def _block(self, texts: list[str], rows: np.ndarray):
        lens = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lens)
        odd = np.zeros(len(texts), bool)
        if len(chars):
            unsafe = (chars >= _TOP) | ~self.safe[np.minimum(chars, _TOP - 1)]
            if unsafe.any():
                at = np.searchsorted(ends, np.flatnonzero(unsafe), side="right")
                odd[at] = True
        if any(s in joined for s in self.special):
            odd |= np.array([any(s in t for s in self.special) for t in texts])
        if odd.any():
            ids, counts = [], np.zeros(len(texts), np.int64)
            for a, b in _stretches(odd):  # keep the order of the texts
                if odd[a]:
                    got = [self.plain(t) for t in texts[a:b]]
                    ids.append(np.fromiter((x for g in got for x in g), np.uint32, sum(map(len, got))))
                    counts[a:b] = [len(g) for g in got]
                else:
                    got, (_, n) = self._block(texts[a:b], rows[a:b])
                    ids.append(got)
                    counts[a:b] = n
            return np.concatenate(ids), (rows, counts)
        if not len(chars):
            return np.zeros(0, np.uint32), (rows, np.zeros(len(texts), np.int64))
        if not self.spaced:
            chars = self.low[chars]
        start, end = split(chars, lens, self.cls, self.spaced)
        if not len(start):
            return np.zeros(0, np.uint32), (rows, np.zeros(len(texts), np.int64))
        row = self._lookup(chars, start, end)
        if row is None:
            got = [self.plain(t) for t in texts]
            return np.fromiter((x for g in got for x in g), np.uint32, sum(map(len, got))), (rows, np.array([len(g) for g in got]))
        n = self.i_len[row]
        ids = self.ids[segments(self.i_start[row], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        word_at = np.searchsorted(start, np.concatenate([[0], ends]), side="left")
        return ids, (rows, np.diff(upto[word_at]))

    def _lookup(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """Each word's row of the table; words it does not hold are encoded, once each.  None: two words share a hash."""
        keys, first, back = np.unique(_hashes(chars, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MAX_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            words = [chars[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            self._grow(keys[new], words, self.word_ids(words))
            at = np.searchsorted(self.keys, keys)
        row = self.rows[at][back]
        n = end - start
        if not np.array_equal(n, self.c_len[row]) or not np.array_equal(chars[segments(start, n)], self.chars[segments(self.c_start[row], n)]):
            return None
        return row


def packed_words(words: list[str], ids: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct words and their ids (side by side, with the number of each word) as the arrays of a ``WordTable``."""
    c_len = np.array([len(w) for w in words], np.int32)
    i_len = np.asarray(lengths, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(c_len, dtype=np.int64) - c_len
    keys, rows = np.unique(_hashes(flat, start, start + c_len), return_index=True)  # of words that share a hash, one
    return {"keys": keys, "rows": rows.astype(np.int32), "c_start": start.astype(np.int32), "c_len": c_len, "chars": flat.astype(np.uint16),
            "i_start": (np.cumsum(i_len, dtype=np.int64) - i_len).astype(np.int32), "i_len": i_len, "ids": np.asarray(ids, np.uint32)}


def _byte_letters() -> dict[int, str]:
    """The visible letter that a byte-level model has for each byte: printable Latin-1 as it is, the rest from 256 on."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


def _pieces(text: str):
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + BLOCK)
        stop = m.start() + 1 if m else len(text)
        yield text[at:stop]
        at = stop


def _stretches(flags: np.ndarray):
    edges = np.flatnonzero(np.diff(flags.astype(np.int8))) + 1
    bounds = [0, *edges.tolist(), len(flags)]
    yield from zip(bounds[:-1], bounds[1:])


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 65536)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word chars[start:end]."""
    up, down = _power(len(chars) + 1)
    v = (chars.astype(np.uint64) + _MIX[0]) * _MIX[1]
    v ^= v >> np.uint64(31)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(v * up[:len(chars)], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[2]
    h ^= h >> np.uint64(32)
    return h * _MIX[1]


def split(chars: np.ndarray, lens: np.ndarray, cls_of: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other in ``chars``.

    spaced: a single space belongs to the word after it and runs of white space
    are words too; otherwise white space is left out and each digit is a word.
    """
    n = len(chars)
    cls = cls_of[chars]
    first = np.zeros(n + 1, bool)
    first[(np.cumsum(lens) - lens)] = True
    first[n] = True
    last = first[1:]
    first = first[:n]
    before = np.empty_like(cls)
    before[0], before[1:] = -1, cls[:-1]
    begins = first | (before != cls)          # of a run of one class
    space = cls == _SPACE
    word = begins & ~space
    if spaced:
        after_blank = np.zeros(n, bool)
        after_blank[1:] = chars[:-1] == 32
        joined = word & after_blank & ~first
        starts = (word & ~joined) | (begins & space)
        ends_space = np.zeros(n, bool)
        ends_space[:-1] = space[:-1] & ~space[1:]
        starts |= ends_space & ~last
        free = word & ~joined
    else:
        starts = word | (cls == _DIGIT)
        free = word
    for i in np.flatnonzero(free & (chars == 39) & ~last).tolist():  # contractions
        a = int(chars[i + 1])
        if cls[i + 1] != _LETTER:
            continue
        if a in (115, 116, 109, 100):
            k = 1
        elif i + 2 < n and not last[i + 1] and (a, int(chars[i + 2])) in ((114, 101), (118, 101), (108, 108)):
            k = 2
        else:
            continue
        starts[i + 1] = False
        if i + k + 1 < n and not last[i + k] and cls[i + k + 1] == _LETTER:
            starts[i + k + 1] = True
    bounds = starts.copy()
    if not spaced:
        bounds |= begins & space
    bounds |= first
    at = np.flatnonzero(bounds)
    ends = np.append(at[1:], n)
    keep = starts[at]
    return at[keep], ends[keep]
