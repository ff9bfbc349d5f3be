"""The numbered queries: each applies its operator to the whole of its table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_table, exact_dedup, jaccard_join, language_hd, packing, prefix_trie, quality_lm, sharding, suffix_dedup, topk, toxicity,
               wavelet, whitening)

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op5_hypergeometric_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), n_shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_bpe_word_table")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer("byte_bpe_50k.json")
    decoded = bpe_table.decode(bpe_table.encode(table(spark, sf_dir, "documents"), file), file)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op6_residual_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2048)


@query("op9_threshold_topk", """
WITH sound AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (
  SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM sound),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 20""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op10_wavelet_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.token_file_folder(spark)
    wavelet.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return wavelet.read_token_files(spark, path)


@query("op3_kneser_ney_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_subword_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS s, unnest([substr(h, 2 * i + 1, 100) for i in range(0, n - 49)]) AS g FROM d WHERE n >= 50),
m AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g),
r AS (SELECT w.doc_id, w.s FROM w JOIN m ON w.g = m.g WHERE w.doc_id > m.lo),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
u AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
q AS (SELECT d.doc_id, d.n, sum(p.b - p.a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(d.h, 2 * p.before + 1, 2 * (p.a - p.before)), '' ORDER BY p.a) || substr(any_value(d.h), 2 * max(p.b) + 1) AS kept
      FROM d JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.n)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed, coalesce(q.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(q.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), threshold=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_prefix_tree_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) >= 3 THEN list_distinct([a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] for i in range(1, len(a) - 1)])
                      WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS na, q.n AS nb, count(*) AS o FROM t p JOIN t q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * o >= 90 * (na + nb - o) UNION ALL SELECT b, a FROM o WHERE 100 * o >= 90 * (na + nb - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.g)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op11_chebyshev_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query("op12_hyperdimensional_language")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_hd.classify(table(spark, sf_dir, "documents"))


@query("op13_radix_prefix_trie", r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS m,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(m ORDER BY pos) AS s FROM t GROUP BY c),
h AS (
  SELECT c, s, c - c % 20 AS base, xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(c AS VARCHAR), '')]),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for i in range(8)]),
                                    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM l),
r AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN l b ON h.base = b.c),
p AS (SELECT c, s[1:d] AS k, d, len(s) = d AS stops, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^ 	-]+')) ELSE 0 END AS words
      FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
             coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE stops), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON n.k = kids.k),
u AS (SELECT k[1:a] AS k, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON f.k = u.k LEFT JOIN n up ON f.d > 0 AND up.k = f.k[1:f.d - 1]""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)
