"""BPE encoding and decoding through a distinct-word table.

1. ``distinct_words``: Spark splits every text into pre-token words, counts
   them per task and adds the counts up.
2. ``word_table``: the most frequent words, at most ``head`` of at most
   ``WORD_CHARS`` characters, are encoded once each.  How frequent they must be
   comes from a histogram of the counts.  That table has a proven size bound and
   is broadcast as flat arrays, which tasks use as they are.
3. ``encode``: every position takes its word's ids.  Words outside the table
   are encoded by the task that meets them, once in its own bounded table:
   joining a row per position instead would shuffle more than twice the input.
4. ``decode``: an id-to-piece join with the vocabulary, whose size is fixed.

Null texts are empty and have no ids.  A text whose ids do not fit a row (2 GiB)
is an error, never left out.  Repeated rows give equal rows; an empty
table gives an empty result.
"""
from __future__ import annotations

import json
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BLOCK, documents, materialise, runs, segments, text_runs

HEAD_WORDS, WORD_CHARS, HELD_WORDS = 200_000, 64, 200_000
#: Bytes of text that a task encodes at once, and steps of the histogram for each doubling of a count.
TEXT_BLOCK, STEPS = 1 << 18, 8
#: A binary value of a Spark row is shorter than this.
ROW_BYTES = 2 ** 31

#: The word table that this worker process has taken over, by tokenizer.
_loaded: dict[str, str] = {}
_vocabularies: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def distinct_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, n: every distinct word of at most WORD_CHARS characters and how often it occurs."""
    def batch_of(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def work(batches):
        table, seen = W.table_for(tokenizer), Counter()
        for batch in batches:
            for _, _, texts in text_runs(batch.column(0), TEXT_BLOCK):
                seen.update(table.count_words(texts, WORD_CHARS))
                if len(seen) > HELD_WORDS:
                    yield batch_of(seen)
                    seen = Counter()
        if seen:
            yield batch_of(seen)
    return documents(docs).select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, tokenizer: str, head: int = HEAD_WORDS) -> DataFrame:
    """word, ids of the most frequent words, each encoded once: whole steps of the histogram, ``head`` words at most."""
    def work(batches):
        table = W.table_for(tokenizer)
        for batch in batches:
            found = batch.column(0).to_pylist()
            if found:
                ids = table.word_ids([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])
    counted = materialise(distinct_words(docs, tokenizer).withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    least, room = None, head
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # 64 * STEPS rows at most
        if r["count"] > room:
            break
        least, room = r["step"], room - r["count"]
    top = counted.where(F.col("step") >= least if least is not None else F.lit(False)).select("word")
    return top.mapInArrow(work, "word string, ids array<int>")


def id_rows(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_tokens and ids of a block of texts; an error where a Spark row cannot hold them."""
    stops = np.concatenate([[0], np.cumsum(counts)]) * 4
    if stops[-1] >= ROW_BYTES:
        raise ValueError(f"documents {doc_ids.to_pylist()[:10]}: {stops[-1]} bytes of ids, a row holds less than {ROW_BYTES}")
    body = pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), body], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, tokenizer: str, head: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    spark = docs.sparkSession
    pairs = word_table(docs, tokenizer, head).toArrow().combine_chunks()
    mark = uuid.uuid4().hex
    lists = pairs.column(1)
    shared = spark.sparkContext.broadcast(W.packed_words(
        pairs.column(0).to_pylist(), pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy()))

    def work(batches):
        table = W.table_for(tokenizer)
        if _loaded.get(tokenizer) != mark:
            table.take(shared.value)
            _loaded[tokenizer] = mark
        for batch in batches:
            ids_of = batch.column(0)
            for a, b, texts in text_runs(batch.column(1), TEXT_BLOCK):
                yield id_rows(ids_of.slice(a, b - a), *table.encode(texts))
    return documents(docs).mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def _pieces_of(tokenizer: str):
    """Bytes of all vocabulary entries, with each id's place and length."""
    if tokenizer not in _vocabularies:
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        back = {ord(c): b for b, c in W._byte_letters().items()}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        parts = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            parts[i] = bytes(back[ord(c)] for c in piece)
        lens = np.array([len(p) for p in parts], np.int64)
        _vocabularies[tokenizer] = (np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens)
    return _vocabularies[tokenizer]


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with the text that the ids stand for."""
    def work(batches):
        flat, start, length = _pieces_of(tokenizer)
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            for a, b in runs(np.array([len(x) for x in blobs], np.int64), 4 * BLOCK):
                ids = np.frombuffer(b"".join(blobs[a:b]), "<u4")
                n = length[ids]
                body = flat[segments(start[ids], n)].tobytes()
                upto = np.concatenate([[0], np.cumsum(n)])
                stops = upto[np.cumsum([0] + [len(x) // 4 for x in blobs[a:b]])].tolist()
                texts = [body[s:e].decode("utf-8", "replace") for s, e in zip(stops[:-1], stops[1:])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])
    return encoded.mapInArrow(work, "doc_id long, n_tokens long, ids binary, text string")
