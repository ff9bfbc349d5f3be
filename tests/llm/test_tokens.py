"""Word-table encoding, packing and token files against the tokenizers library itself."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ticketlens.llm import bpe_table, packing, wavelet, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows():
    rnd = random.Random(9)
    pool = ["the ", "Idiot's", " 12,", "\n\n", "É", "don't", "  ", "漢", "😀", "<|endoftext|>", "x" * 90, " word"]
    out = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    return out + [(500, None), (501, ""), (502, "long text here " * 4000), (3, out[3][1]), (3, "another with this id"), (None, "no id")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, n_tokens int")


def plain(path, data):
    table = words.WordTable(path)
    return [(i, table.plain(t or "")) for i, t in data]


def sortable(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("head", [5, 1000])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encode_and_decode(spark, path, head):
    data = rows()
    enc = bpe_table.encode(frame(spark, data).repartition(3), path, head)
    got = bpe_table.decode(enc, path).collect() if path == BYTE else enc.collect()
    want = plain(path, data)
    assert sortable((r.doc_id, r.n_tokens, bytes(r.ids).hex()) for r in got) == sortable(
        (i, len(x), np.array(x, "<u4").tobytes().hex()) for i, x in want)
    if path == BYTE:
        assert sortable((r.doc_id, r.text) for r in got) == sortable((i, t or "") for i, t in data)


def test_word_table_holds_each_word_once(spark):
    data = rows()
    got = bpe_table.word_table(frame(spark, data), BYTE, 10_000).collect()
    assert len({r.word for r in got}) == len(got)
    table = words.WordTable(BYTE)
    assert all(r.ids == table.plain(r.word) for r in got)


def test_word_table_keeps_to_its_bound(spark):
    data = [(i, " ".join(f"w{k}" for k in range(40) for _ in range(1 + k % 9))) for i in range(3)]
    counts = {r.word: r.n for r in bpe_table.distinct_words(frame(spark, data), BYTE).collect()}
    for head in (0, 1, 7, 20, len(counts)):
        got = [r.word for r in bpe_table.word_table(frame(spark, data), BYTE, head).collect()]
        assert len(got) <= head and (not got or min(counts[w] for w in got) > max((n for w, n in counts.items() if w not in got), default=0))
    assert len(got) == len(counts)


def test_packing(spark):
    data = rows()
    got = packing.pack(packing.pieces(frame(spark, data).repartition(3), BYTE, 256), 256, group_items=40, fan_in=3).collect()
    want = []
    for i, ids in plain(BYTE, data):
        ids, at, k = ids + [0], 0, 0
        while at < len(ids):
            step = len(ids) % 256 or 256 if k == 0 else 256
            part = ids[at:at + step]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at, k = at + step, k + 1
    assert sortable((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sortable(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert len(seqs) <= 1.02 * sum(w[3] for w in want) / 256 + 1


def test_packing_items_that_never_share(spark):
    items = spark.range(300).selectExpr("id doc_id", "0 piece", "0L start", "150 length", "id ids_crc32")
    got = packing.pack(items, 256, group_items=20, fan_in=3).collect()
    assert len({r.sequence_id for r in got}) == 300
    assert packing.pack(items.limit(0)).collect() == []


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


def test_token_files(spark, tmp_path):
    data = rows()
    path = str(tmp_path / "files")
    wavelet.write_token_files(frame(spark, data).repartition(4), path, WORD, end_id=1, shard_tokens=700)
    got = sortable(tuple(r) for r in wavelet.read_token_files(spark, path).collect())
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, ids in plain(WORD, order):
        ids = ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sortable(want)
    assert spark.read.parquet(path).count() > 5


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    wavelet.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, WORD)
    assert wavelet.read_token_files(spark, path).collect() == []


def test_wavelet_matrix():
    rnd = np.random.default_rng(2)
    for n, top in ((1, 1), (7, 3), (1500, 49408), (3000, 9)):
        ids = rnd.integers(0, top, n)
        m, docs, counts = wavelet.from_file(wavelet.to_file(ids.astype(np.uint32), [4, None], np.array([1, n - 1])))
        assert docs == [4, None] and counts.tolist() == [1, n - 1]
        assert m.all().tolist() == ids.tolist() == m.access(np.arange(n)).tolist()
        for s in {*ids[:5].tolist(), 70000}:
            places = np.flatnonzero(ids == s).tolist()
            assert m.count(s) == len(places) and m.occurrences(s) == places
            assert [m.rank(s, k) for k in (0, n // 2, n)] == [sum(p < k for p in places) for k in (0, n // 2, n)]


def test_ids_beyond_a_row_are_an_error(monkeypatch):
    import pyarrow as pa
    ids, counts = np.arange(5, dtype=np.int64), np.array([2, 0, 3])
    got = bpe_table.id_rows(pa.array([7, 8, 9]), ids, counts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got.column(2).to_pylist()] == [[0, 1], [], [2, 3, 4]]
    monkeypatch.setattr(bpe_table, "ROW_BYTES", 20)
    with pytest.raises(ValueError, match="7, 8, 9"):
        bpe_table.id_rows(pa.array([7, 8, 9]), ids, counts)
