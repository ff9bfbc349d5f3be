"""TF-IDF similarity, duplicate search and retrieval.

Vectors are long tables ``(id, term, tf, ...)`` so that similarity is a join on
``term``.  A plain inverted-index join emits every pair of texts sharing a
term -- quadratic in a common term's posting list -- so candidate generation
uses *prefix filtering*: terms are put in one global order (rarest first) and
each vector indexes only the leading terms whose remaining suffix could still
reach the threshold.  Two vectors with cosine >= t always share a term inside
both prefixes (Cauchy-Schwarz on the suffix after their first shared term), so
the candidate set is exact, and common terms only enter the index for texts
made of nothing but common terms.  Exact copies are collapsed to one distinct
text first (a group of copies would otherwise be all-pairs by construction);
for top-k output only the first k members of a copy group can ever be chosen.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V

TOKEN_RX = "[\\p{L}\\p{N}_]{2,}"  # \b\w\w+\b with Unicode word characters
EPS = 1e-9
#: Bytes of text in a partition whose terms a task counts, and (query, policy) scores that a task adds up.
PART_BYTES, PART_PAIRS = 4 << 20, 500_000
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The block that a row's id belongs to.
BLOCK = "_block"


# V1 ---------------------------------------------------------------------------
def with_terms(df: DataFrame, text: str, stop_words=None, out: str = "terms", ngram_max: int = 2) -> DataFrame:
    """Adds ``out``: lower-cased word tokens (>= 2 word characters), stop words
    removed, then 1-grams followed by 2-grams (bigrams span removed words)."""
    stop = list(V.default_stop_words() if stop_words is None else stop_words)
    toks = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_RX), F.lit(0))
    if stop:
        toks = F.filter(toks, lambda x: ~x.isin(*stop))
    if ngram_max < 2:
        return df.withColumn(out, toks)
    # Bigrams pair each token with the next one (zip of the array with itself
    # shifted by one); no lambda refers back to the token array, so the token
    # expression is evaluated a fixed number of times per row.
    bigrams = F.zip_with(toks, F.slice(toks, 2, F.lit(1 << 30)),
                         lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return df.withColumn(out, F.concat(toks, F.array_compact(bigrams)))


def text_parts(df: DataFrame, text: str) -> int:
    """Partitions of about ``PART_BYTES`` of text each, so that a task's terms are as many at every size; one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES))  # one number


def term_counts(df: DataFrame, id_col: str, text: str, stop_words=None, parts: int | None = None) -> DataFrame:
    """(id, term, tf) raw term frequencies.

    Texts are hash-partitioned by id once, into ``parts`` (``text_parts`` unless
    given); the (id, term) count and any later per-id window then reuse that
    partitioning, so term rows -- about twice the size of the text -- are never
    shuffled just to be counted."""
    src = df.select(id_col, text).repartition(parts or text_parts(df, text), id_col)
    t = with_terms(src, text, stop_words)
    return (t.select(id_col, F.explode("terms").alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def in_blocks(df: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``df`` dealt by id into ``parts`` blocks, each a partition of its own."""
    tried = df.sparkSession.range(parts * (parts.bit_length() + 8)).select(F.col("id").cast("int").alias("v"))
    place = F.pmod(F.hash("v"), F.lit(parts)).alias("p")  # where Spark puts a row by its value
    found = {r["p"]: r["v"] for r in tried.groupBy(place).agg(F.min("v").alias("v")).collect()}  # a row a partition
    names = F.array(*[F.lit(found.get(p, p)) for p in range(parts)])
    return df.withColumn(BLOCK, F.element_at(names, F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int") + 1)).repartition(parts, BLOCK)


def block_terms(blocks: DataFrame, keep: list[str], text: str, stop_words=None) -> DataFrame:
    """BLOCK, the columns to keep (an id and what it decides), term and tf of ``in_blocks``' rows, in their partitions."""
    t = with_terms(blocks, text, stop_words).select(BLOCK, *keep, F.explode("terms").alias("term"))
    return t.groupBy(BLOCK, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def over_terms(rows: DataFrame, parts: int, found: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """``rows`` of blocks, each with what is found over all rows of its term: name -> (aggregate, how its values combine).

    The rows stay where they are.  A block sends each different term once, and
    hears back only of terms for which other blocks change what it found itself."""
    own = rows.groupBy(BLOCK, "term").agg(*[how.alias(k) for k, (how, _) in found.items()])
    every = Window.partitionBy("term")  # a row a block
    whole = own.select(BLOCK, "term", *found, *[combine(F.col(k)).over(every).alias(f"_{k}") for k, (_, combine) in found.items()])
    changed = reduce(Column.__or__, [~F.col(k).eqNullSafe(F.col(f"_{k}")) for k in found])
    heard = whole.where(changed).select(BLOCK, "term", *[F.col(f"_{k}").alias(k) for k in found]).repartition(parts, BLOCK)
    here = Window.partitionBy(BLOCK, "term")
    kinds = dict(heard.dtypes)
    given = rows.select("*", F.lit(True).alias("_own"), *[F.lit(None).cast(kinds[k]).alias(f"_{k}") for k in found])
    told = heard.select(*[F.col(c) if c in (BLOCK, "term") else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes],
                        F.lit(False).alias("_own"), *[F.col(k).alias(f"_{k}") for k in found])
    both = given.unionByName(told)  # keeps the blocks' partitions
    values = [F.coalesce(F.max(f"_{k}").over(here), how.over(here)).alias(k) for k, (how, _) in found.items()]
    return both.select(*rows.columns, "_own", *values).where("_own").drop("_own")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an intermediate read more than once (written to
    the session's checkpoint directory, so it survives executor loss).

    The shuffle files behind it are of no more use and are removed at once."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan made under the setting
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


# V2 ---------------------------------------------------------------------------
def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed idf: ln((1 + n) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def tfidf_fit(docs: DataFrame, id_col: str, text: str, stop_words=None) -> tuple[DataFrame, DataFrame]:
    """Fit on ``docs``: returns (vectors (id, term, tf, idf, weight) L2-normalised,
    vocabulary (term, df, idf)).  n counts every document, empty ones too."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    parts = text_parts(docs, text)
    tc = block_terms(in_blocks(docs.select(id_col, text), id_col, parts), [id_col], text, stop_words)
    vocab = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(n, F.col("df")))
    w = over_terms(tc, parts, {"df": (F.count(F.lit(1)), F.sum)}).withColumn("idf", idf(n, F.col("df"))).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(BLOCK, id_col)))
    return w.select(id_col, "term", "tf", "idf", (F.col("w") / norm).alias("weight")), vocab


def transform(queries: DataFrame, id_col: str, text: str, vocab: DataFrame, stop_words=None, parts: int | None = None) -> DataFrame:
    """Query vectors in a fitted vocabulary; unknown terms dropped before L2."""
    tc = term_counts(queries, id_col, text, stop_words, parts)
    w = tc.join(vocab.select("term", "idf"), on="term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


# Prefix filter ------------------------------------------------------------------
def prefix_terms(vectors: DataFrame, id_col: str, weight: str, rank: str, bound: float) -> DataFrame:
    """Rows of ``vectors`` whose term lies in the id's prefix: the suffix norm
    from this term on (terms ordered by ``rank``, rarest first) is >= bound."""
    w = Window.partitionBy(id_col).orderBy(F.col(rank).desc(), F.col("term").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suffix = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(w))
    return vectors.withColumn("_suffix", suffix).where(F.col("_suffix") >= F.lit(bound - EPS)).drop("_suffix")


# V4 ---------------------------------------------------------------------------
def collapse_copies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Distinct texts: (text_key, text, rep_id = smallest id, n_copies)."""
    return df.groupBy(F.col(text).alias("text")).agg(
        F.min(id_col).alias("rep_id"), F.count(F.lit(1)).alias("n_copies")).withColumn("text_key", F.md5("text"))


def duplicate_pairs(df: DataFrame, id_col: str, text: str, threshold: float = V.DUPLICATE_THRESHOLD,
                    stop_words=None) -> DataFrame:
    """Near-duplicate pairs of distinct texts (corpus-level fit over every row):
    (id_a, id_b, similarity, copies_a, copies_b), id = smallest id of the text,
    id_a < id_b, cosine >= threshold.

    Candidate pruning is exact: a term held by a single distinct text cannot be
    shared, so it never enters a prefix or the verification; a text's prefix
    ends where the remaining shareable terms can no longer reach the threshold
    by either bound -- their L2 norm, or the sum of weight x the largest weight
    any text gives that term (the AllPairs max-weight bound)."""
    distinct = collapse_copies(df, id_col, text)
    n = df.agg(F.count(F.lit(1))).scalar()
    cnt = distinct.select("rep_id", "n_copies")
    parts = text_parts(df, text)
    # An id of several texts is one vector that counts for all of them; a null id is in no pair.
    of_id = Window.partitionBy(BLOCK, "rep_id")
    blocks = in_blocks(distinct.where(F.col("rep_id").isNotNull()).select("rep_id", "text", "n_copies"), "rep_id", parts)
    blocks = blocks.select(BLOCK, "rep_id", "text", F.sum("n_copies").over(of_id).alias("copies"), F.count(F.lit(1)).over(of_id).alias("texts"))
    tc = block_terms(blocks, ["rep_id", "copies", "texts"], "text", stop_words)
    w = over_terms(tc, parts, {"df": (F.sum("copies"), F.sum), "df_texts": (F.sum("texts"), F.sum)})
    w = w.withColumn("w", F.col("tf") * idf(n, F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(BLOCK, "rep_id")))
    vec = w.select(BLOCK, "rep_id", "term", "df", "df_texts", (F.col("w") / norm).alias("weight"))
    # Only shareable terms matter from here on; cosine uses the full norm above.
    shared = vec.where(F.col("df_texts") >= 2).drop("df_texts")
    by_rank = Window.partitionBy(BLOCK, "rep_id").orderBy(F.col("df").desc(), F.col("term").desc())
    upto = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # norm / reach: what this and the later (more common) terms can add at most; norm_after / reach_after: the later ones alone
    w2, wm = F.col("weight") * F.col("weight"), F.col("weight") * F.col("maxw")
    sv = (over_terms(shared, parts, {"maxw": (F.max("weight"), F.max)})
          .withColumn("norm", F.sqrt(F.sum(w2).over(upto))).withColumn("reach", F.sum(wm).over(upto))
          .withColumn("norm_after", F.sqrt(F.greatest(F.col("norm") * F.col("norm") - w2, F.lit(0.0))))
          .withColumn("reach_after", F.col("reach") - wm)
          .withColumn("indexed", F.least("norm", "reach") >= F.lit(threshold - EPS)))
    # What only indexed rows need is null in the others: they are the most, and an empty struct takes no room.
    index = F.when(F.col("indexed"), F.struct("df", "norm_after", "reach_after")).alias("index")
    sv = materialise(sv.select("rep_id", "term", "weight", index))
    cand = candidate_pairs(sv.where(F.col("index").isNotNull()).select("rep_id", "term", "weight", "index.*"), threshold)
    # Exact cosine: the indexed part is summed already; the text whose index ends first sends its remaining terms.
    rest = sv.where(F.col("index").isNull()).select("rep_id", "term", "weight")
    left = cand.where("remaining").select("id_a", "id_b", F.when(F.col("a_first"), F.col("id_a")).otherwise(F.col("id_b")).alias("sends"),
                                          F.when(F.col("a_first"), F.col("id_b")).otherwise(F.col("id_a")).alias("other"))
    sent = left.join(rest.withColumnRenamed("rep_id", "sends").withColumnRenamed("weight", "w1"), on="sends")
    met = sent.join(sv.select(F.col("rep_id").alias("other"), "term", F.col("weight").alias("w2")), on=["other", "term"])
    sims = cand.select("id_a", "id_b", F.col("partial").alias("s")).unionByName(
        met.select("id_a", "id_b", (F.col("w1") * F.col("w2")).alias("s"))).groupBy("id_a", "id_b").agg(F.sum("s").alias("similarity"))
    out = sims.where(F.col("similarity") >= F.lit(threshold))
    ca = cnt.select(F.col("rep_id").alias("id_a"), F.col("n_copies").alias("copies_a"))
    cb = cnt.select(F.col("rep_id").alias("id_b"), F.col("n_copies").alias("copies_b"))
    return out.join(ca, on="id_a").join(cb, on="id_b")


def candidate_pairs(pre: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id_a < id_b) whose indexed terms' product plus the most that the
    remaining terms can add reaches the threshold.

    A shared term that only one of the two texts indexes ranks behind the end of
    the other's index, so past the first end only that text's remaining terms
    count: by their norm times the other text's norm behind the last common
    indexed term, or by the largest weights any text gives them.  Norms fall along
    the order of terms, so the least is the last one's.  The many pairs carry
    numbers alone, and meet the ends of the two indexes if both norms behind the
    last common term leave them a chance."""
    same = ["term", "df"]  # a term has one df; with both as keys the two sides are one shuffle
    # a float that is not too small does for a bound
    short = pre.select("rep_id", *same, "weight", (F.col("norm_after") * 1.000001).cast("float").alias("after"))
    a, b = (short.select(*[F.col(c).alias(c if c in same else f"{x}_{c}") for c in short.columns]) for x in "ab")
    met = a.join(b, on=same).where(F.col("a_rep_id") < F.col("b_rep_id"))
    pair = met.groupBy(F.col("a_rep_id").alias("id_a"), F.col("b_rep_id").alias("id_b")).agg(
        F.sum(F.col("a_weight") * F.col("b_weight")).alias("partial"), F.min("a_after").alias("na"), F.min("b_after").alias("nb"))
    pair = pair.where(F.col("partial") + F.col("na").cast("double") * F.col("nb") >= F.lit(threshold - EPS))
    # where each text's index ends, and what its remaining terms can add
    ends = pre.groupBy("rep_id").agg(F.max(F.struct("df", "term", "norm_after", "reach_after")).alias("end"))
    for x in "ab":
        pair = pair.join(ends.select(F.col("rep_id").alias(f"id_{x}"), F.col("end").alias(f"e{x}")), on=f"id_{x}")
    a_first = F.struct("ea.df", "ea.term") <= F.struct("eb.df", "eb.term")
    mine = F.when(a_first, F.col("ea")).otherwise(F.col("eb"))
    more = F.least(mine["norm_after"] * F.when(a_first, F.col("nb")).otherwise(F.col("na")), mine["reach_after"])
    return pair.where(F.col("partial") + more >= F.lit(threshold - EPS)).select(
        "id_a", "id_b", "partial", a_first.alias("a_first"), (mine["norm_after"] > 0).alias("remaining"))


def exact_copies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Copy groups (more than one row with the same text): rep_id, n_copies."""
    return collapse_copies(df, id_col, text).where(F.col("n_copies") > 1).select("rep_id", "n_copies")


# V3 ---------------------------------------------------------------------------
#: Terms that so many open tickets hold, or fewer, are met ticket by ticket; the others class by class.
RARE_DF = 32


def _signature(terms: DataFrame, key: str) -> DataFrame:
    """key, sig: a 128-bit name of a text's common terms with their counts and, of its rare terms, of the pairs
    (df, tf) alone.  terms: (key, term, tf, df)."""
    rare = F.col("df") <= RARE_DF
    what = [F.when(~rare, F.col("term")), F.when(rare, F.col("df").cast("long")).otherwise(F.lit(-1).cast("long")), F.col("tf")]
    sums = [F.sum(F.xxhash64(F.lit(k), *what).cast("decimal(20,0)")).cast("string") for k in (0, 1)]
    return terms.groupBy(key).agg(F.concat_ws(":", *sums).alias("sig"))


def duplicate_candidates(messages: DataFrame, tickets: DataFrame, msg_id: str = "message_id",
                         threshold: float = V.DUPLICATE_THRESHOLD, limit: int = V.DUPLICATE_LIMIT,
                         stop_words=None, own: str | None = None) -> DataFrame:
    """For every message, up to ``limit`` open tickets with cosine >= threshold,
    exactly as if the vectoriser were refitted on (message + open tickets) per
    message.

    ``messages``: (msg_id, text and, if given, ``own``: whether the message is itself
    the open ticket of that id, which it is then not compared with); ``tickets``:
    (ticket_id, created_at, text, status, department) -- the unresolved tickets.
    Output: msg_id, rank, ticket_id, similarity (4 dp), status, department.
    Ranking: rounded similarity descending, then store order (created_at,
    ticket_id).  Null texts are empty; a text without terms has no candidates.

    Refit without refitting.  N tickets hold a term df times.  A message that is
    no open ticket adds one to n and to the df of its own terms: with
    idf_b = ln((2+N)/(1+df)) + 1 and idf_q = ln((2+N)/(2+df)) + 1, a ticket's norm
    is ||t||_b^2 + sum over shared terms of tf^2 (idf_q^2 - idf_b^2).  A message
    that is an open ticket takes its own row out and puts it back as the message:
    all norms and dots use ln((1+N)/(1+df)) + 1.

    Texts from one template differ in terms that few tickets hold.  Texts with
    equal common terms and equal (df, tf) pairs of rare ones have equal norms, and
    two such classes have one similarity as long as no rare term is shared, so
    classes are compared instead of texts.  Pairs of texts that share a rare
    term (a list of ``RARE_DF`` tickets at most) are found by that term and get
    the rest on top.  A shared term only raises a similarity, so the first
    limit + 1 tickets of a class, by the class's similarity, are all that can be
    chosen beside those pairs.
    """
    flag = F.lit(False) if own is None else F.coalesce(F.col(own), F.lit(False))
    msgs = materialise(messages.select(msg_id, F.coalesce(F.col("text"), F.lit("")).alias("text"), flag.alias("own"))
                       .withColumn("mkey", F.concat(F.md5("text"), F.col("own").cast("int").cast("string"))))
    tk = tickets.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("okey", F.md5("text"))
    tk = materialise(tk.select("ticket_id", "created_at", "text", "status", "department", "okey"))
    n_open = tk.agg(F.count(F.lit(1))).first()[0]  # one number
    otexts = tk.groupBy("okey").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n_copies"))
    otc = materialise(term_counts(otexts, "okey", "text", stop_words).join(otexts.select("okey", "n_copies"), "okey"))
    # From here on a term is its number, a class too: pairs of classes and terms are many, and longs are short.
    dfo = materialise(otc.groupBy("term").agg(F.sum("n_copies").alias("df"))).withColumn("number", F.monotonically_increasing_id())
    oterms = materialise(otc.join(dfo, "term").select("okey", F.col("number").alias("term"), "tf", "df"))
    mtexts = msgs.groupBy("mkey").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    mtc = term_counts(mtexts, "mkey", "text", stop_words).join(dfo, "term", "left")
    mterms = materialise(mtc.select("mkey", F.col("number").alias("term"), "tf", F.coalesce("df", F.lit(0)).alias("df")))  # null: no ticket holds it

    own_of = F.substring("mkey", 33, 1) == "1"

    def idfs(own_flag: Column) -> tuple[Column, Column]:
        """idf of terms the message lacks, and of those it has."""
        base = F.when(own_flag, F.log(F.lit(1.0 + n_open) / (1.0 + F.col("df")))).otherwise(F.log(F.lit(2.0 + n_open) / (1.0 + F.col("df")))) + 1.0
        shared = F.when(own_flag, F.log(F.lit(1.0 + n_open) / (1.0 + F.col("df")))).otherwise(F.log(F.lit(2.0 + n_open) / (2.0 + F.col("df")))) + 1.0
        return base, shared

    # classes: those of messages also tell whether they are open tickets
    def numbered(signed: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        """(key, name) of every text, its class numbered, and (name, key) of one text a class.  signed: (key, sig)."""
        signed = materialise(signed)
        heads = materialise(signed.groupBy("sig").agg(F.min(key).alias(key))).withColumn(name, F.monotonically_increasing_id())
        return materialise(signed.join(heads.select("sig", name), "sig").select(key, name)), heads.select(name, key)
    mclass, mheads = numbered(_signature(mterms, "mkey").select("mkey", F.concat("sig", F.lit("/"), F.substring("mkey", 33, 1)).alias("sig")), "mkey", "mc")
    oclass, oheads = numbered(_signature(oterms, "okey"), "okey", "oc")
    mrows = mterms.join(mheads, "mkey").select("mc", "term", "tf", "df", own_of.alias("own"))
    orows = oterms.join(oheads, "okey").select("oc", "term", "tf", "df")
    mv = mrows.withColumn("idf_b", idfs(F.col("own"))[0]).withColumn("idf_q", idfs(F.col("own"))[1])
    wm2 = F.sum(F.pow(F.col("tf") * F.col("idf_q"), 2)).over(Window.partitionBy("mc"))
    mv = materialise(mv.withColumn("m2", wm2))
    ov = orows.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("idf_b", idfs(F.col("own"))[0]).withColumn("idf_q", idfs(F.col("own"))[1])
    ov = materialise(ov.withColumn("o2", F.sum(F.pow(F.col("tf") * F.col("idf_b"), 2)).over(Window.partitionBy("oc", "own"))))

    # Prefix filter over common terms, rarest first: message side exact; ticket side
    # loosened by the smallest idf_q / idf_b ratio, so the refit can only shrink it.
    common = F.col("df") > RARE_DF

    def prefix(rows: DataFrame, weight: Column, norm2: str, by: list[str], loose: float) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reach = F.sqrt(F.sum(weight * weight).over(w) / F.col(norm2))
        return rows.where(common).withColumn("_reach", reach).where(F.col("_reach") >= F.lit(threshold * loose - EPS)).select(*by, "own", "term")
    loose = (math.log((2.0 + n_open) / 3.0) + 1.0) / (math.log((2.0 + n_open) / 2.0) + 1.0)
    mpre = prefix(mv, F.col("tf") * F.col("idf_q"), "m2", ["mc"], 1.0)
    opre = prefix(ov, F.col("tf") * F.col("idf_b"), "o2", ["oc", "own"], loose).select("oc", "own", "term")
    near = mpre.join(opre, ["own", "term"]).select("mc", "oc").distinct()

    # pairs of texts that share a rare term; own is the message's
    rare = (mterms.where(~common).withColumn("own", own_of).join(oterms.where(~common).select("okey", "term", F.col("tf").alias("tf_o")), "term")
            .withColumn("idf_b", idfs(F.col("own"))[0]).withColumn("idf_q", idfs(F.col("own"))[1]))
    q2, b2 = F.col("idf_q") * F.col("idf_q"), F.col("idf_b") * F.col("idf_b")
    rare = rare.groupBy("mkey", "okey").agg(F.sum(F.col("tf") * F.col("tf_o") * q2).alias("rare_dot"),
                                            F.sum(F.col("tf_o") * F.col("tf_o") * (q2 - b2)).alias("rare_corr"))
    rare = materialise(rare.join(mclass, "mkey").join(oclass, "okey"))

    # common part of every pair of classes that is needed
    pairs = near.unionByName(rare.select("mc", "oc")).distinct()
    met = (pairs.join(mv.where(common).select("mc", "own", "term", F.col("tf").alias("tf_m"), "idf_b", "idf_q"), "mc")
           .join(ov.where(common).select("oc", "own", "term", F.col("tf").alias("tf_o")), ["oc", "own", "term"]))
    dots = met.groupBy("mc", "oc").agg(F.sum(F.col("tf_m") * F.col("tf_o") * q2).alias("dot"), F.sum(F.col("tf_o") * F.col("tf_o") * (q2 - b2)).alias("corr"))
    m2 = mv.select("mc", "own", "m2").distinct()
    o2 = ov.select("oc", "own", "o2").distinct()
    base = pairs.join(dots, ["mc", "oc"], "left").na.fill(0.0, ["dot", "corr"]).join(m2, "mc").join(o2, ["oc", "own"])
    base = materialise(base.select("mc", "oc", "dot", "corr", "m2", "o2"))

    def kept(rows: DataFrame, dot: Column, corr: Column) -> DataFrame:
        sim = dot / F.sqrt(F.col("m2") * (F.col("o2") + corr))
        return rows.withColumn("sim", sim).where(F.col("sim") >= F.lit(threshold)).withColumn("similarity", F.round("sim", 4))
    order = [F.col("similarity").desc(), F.col("created_at"), F.col("ticket_id")]
    store = tk.select("okey", "created_at", "ticket_id")

    def first_of(rows: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy("created_at", "ticket_id")
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit + 1).drop("_n")
    of_class = first_of(store.join(oclass, "okey"), "oc").select("oc", "created_at", "ticket_id")
    of_text = first_of(store, "okey")
    by_class = kept(base, F.col("dot"), F.col("corr")).join(of_class, "oc")
    top = by_class.withColumn("_n", F.row_number().over(Window.partitionBy("mc").orderBy(*order))).where(F.col("_n") <= limit + 1)
    from_class = mclass.join(top.select("mc", "similarity", "created_at", "ticket_id"), "mc").drop("mc")
    special = kept(rare.join(base, ["mc", "oc"]), F.col("dot") + F.col("rare_dot"), F.col("corr") + F.col("rare_corr"))
    from_text = special.select("mkey", "okey", "similarity").join(of_text, "okey").drop("okey")
    both = from_class.unionByName(from_text).groupBy("mkey", "ticket_id", "created_at").agg(F.max("similarity").alias("similarity"))
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy("mkey").orderBy(*order))).where(F.col("_n") <= limit + 1).drop("_n")
    lists = best.groupBy("mkey").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("similarity")).alias("s"), "created_at", "ticket_id"))).alias("hits"))  # limit + 1 of them
    mine = F.filter("hits", lambda h: ~(F.col("own") & (h["ticket_id"] == F.col(msg_id))))
    chosen = msgs.join(lists, "mkey").select(msg_id, F.posexplode(F.slice(mine, 1, limit)).alias("_at", "h"))
    return chosen.select(msg_id, (F.col("_at") + 1).alias("rank"), F.col("h.ticket_id").alias("ticket_id"), (-F.col("h.s")).alias("similarity")).join(
        tk.select("ticket_id", "status", "department"), "ticket_id").select(msg_id, "rank", "ticket_id", "similarity", "status", "department")


# V5, V7 -----------------------------------------------------------------------
def search_policies(queries: DataFrame, policies: DataFrame, k: int = V.RETRIEVAL_K, query_id: str = "query_id",
                    stop_words=None) -> DataFrame:
    """Lexical retrieval: for every query exactly ``k`` policies (zero scores
    kept), cosine over a vectoriser fitted on the policies (title + content),
    score rounded to 4 dp, equal scores -> later policy first.

    ``policies``: (policy_idx long, policy_id, title, content).  Equal query texts
    are scored once.  Spark chooses each join by the size of its sides.
    """
    p = policies.select("policy_idx", "policy_id", F.concat_ws(" ", "title", "content").alias("ptext"))
    pvec, vocab = tfidf_fit(p, "policy_idx", "ptext", stop_words)
    keyed = queries.select(query_id, F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_q", F.md5("text"))
    # A task holds the scores of its queries against every policy: parts by their number, and by the texts' size.
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_policies = policies.agg(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-size["n"] * n_policies // PART_PAIRS), -(-(size["b"] or 0) // PART_BYTES))
    texts = keyed.select("_q", "text").repartition(parts, "_q").groupBy("_q").agg(F.first("text").alias("text"))   # one text per key
    qvec = transform(texts, "_q", "text", vocab, stop_words, parts)
    pv = pvec.select("policy_idx", "term", F.col("weight").alias("pw"))
    scored = qvec.join(pv, on="term").groupBy("_q", "policy_idx").agg(
        F.sum(F.col("weight") * F.col("pw")).alias("score"))
    w = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("policy_idx").desc())
    best = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("_q").agg(
        F.collect_list(F.struct("policy_idx", "score")).alias("_best"))  # k of them at most
    # Zero-score fill: the k policies that win ties at 0 (largest index first).
    fill = policies.orderBy(F.col("policy_idx").desc()).limit(k).agg(
        F.collect_list(F.struct("policy_idx", F.lit(0.0).alias("score"))).alias("_fill"))  # k values at most
    found = F.coalesce("_best", F.array().cast("array<struct<policy_idx:bigint,score:double>>"))
    zeros = F.filter(F.array_distinct("_fill"), lambda z: z["policy_idx"].isNotNull() & ~F.exists(found, lambda h: h["policy_idx"].eqNullSafe(z["policy_idx"])))
    order = F.array_sort(F.transform(F.concat(found, zeros), lambda h: F.struct((-h["score"]).alias("s"), F.coalesce(-h["policy_idx"], F.lit((1 << 63) - 1)).alias("i"), h["policy_idx"].alias("policy_idx"))))
    filled = texts.select("_q").join(best, "_q", "left").withColumn("_fill", fill.select("_fill").scalar())
    top = filled.select("_q", F.posexplode(F.slice(order, 1, k)).alias("_at", "h")).select(
        "_q", "h.policy_idx", (-F.col("h.s")).alias("score"), (F.col("_at") + 1).alias("rank"))
    meta = policies.select("policy_idx", "policy_id", "title", "content")
    hits = top.join(meta, on="policy_idx").groupBy("_q").agg(F.collect_list(F.struct(
        "rank", "policy_idx", "policy_id", "title", "content", F.round("score", 4).alias("score"))).alias("_hits"))  # k of them
    return keyed.select(query_id, "_q").join(hits, on="_q").select(query_id, F.inline("_hits")).withColumn("backend", F.lit(V.RETRIEVAL_BACKEND))


# V6 ---------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    """The vector at length one; null for a null or zero vector and one that holds a null or non-finite entry."""
    nrm = F.sqrt(dot(v, v))
    return F.when(sound(v) & (nrm > 0), F.transform(v, lambda x: F.try_divide(x.cast("double"), nrm)))


def sound(v: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def search_vectors(queries: DataFrame, index: DataFrame, k: int = V.RETRIEVAL_K, query_id: str = "query_id",
                   vector: str = "vector", block_rows: int = 8192, exclude_self: bool = False) -> DataFrame:
    """Exact inner-product top-k of unit vectors against an index table
    (index_id, index_vector) of any size.

    The index is dealt into blocks of bounded size and every query meets every
    block (a stated query set in blocks); a block's scores are one matrix product
    in its task and only its k best leave it, to be merged by rank.  Equal scores:
    the smaller index_id first.

    Vectors that are null or hold a null or non-finite entry take no part, on either
    side.  A zero vector scores 0.  Shorter vectors count as filled up with zeros."""
    import numpy as np
    import pyarrow as pa

    index, queries = index.where(sound(F.col("index_vector"))), queries.where(sound(F.col(vector)))
    size = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("index_vector")).alias("d")).first()
    blocks, d = max(1, -(-size["n"] // block_rows)), max(size["d"] or 0, queries.agg(F.max(F.size(vector))).first()[0] or 0)
    rows = index.select(F.pmod(F.xxhash64("index_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"),
                        F.col("index_id").cast("long").alias("id"), F.transform("index_vector", lambda x: x.cast("double")).alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"),
                           F.col(query_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    met = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "id")

    def matrix(lists):
        n = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), d))
        out[np.repeat(np.arange(len(lists)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
        return out

    def best(ids, v, qids, q):
        score = q @ v.T
        if exclude_self:
            score[qids[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        top = np.take_along_axis(score, order, axis=1)
        row, col = np.nonzero(top > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[order[row, col]]), pa.array(top[row, col])],
                                          names=[query_id, "index_id", "score"])

    def work(batches):
        block, ids, vecs = None, [], []
        for batch in batches:
            blk, asks, vid = (c.to_numpy() for c in batch.columns[:3])
            edges = [0, *(np.flatnonzero((np.diff(blk) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(blk)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if blk[a] != block:
                    block, ids, vecs = blk[a], [], []
                part = matrix(batch.column(3).slice(a, b - a))
                if not asks[a]:
                    ids.append(vid[a:b])
                    vecs.append(part)
                elif ids:
                    for at in range(0, b - a, 256):
                        yield best(np.concatenate(ids), np.concatenate(vecs), vid[a + at:min(b, a + at + 256)], part[at:at + 256])
    partial = met.mapInArrow(work, f"{query_id} long, index_id long, score double")
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), "index_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", "index_id", "score")


# V8 ---------------------------------------------------------------------------
def suggest(escalated: Column, top_score: Column, top_content: Column, top_id: Column) -> Column:
    """Grounded suggestion from the best retrieved policy."""
    none = F.struct(F.lit(V.ANSWER_NONE).alias("answer"), F.lit(False).alias("grounded"),
                    F.lit(None).cast("string").alias("source_id"))
    esc = F.struct(F.lit(V.ANSWER_ESCALATED).alias("answer"), F.lit(False).alias("grounded"),
                   F.lit(None).cast("string").alias("source_id"))
    ok = F.struct(F.concat(F.lit(V.ANSWER_PREFIX), top_content).alias("answer"), F.lit(True).alias("grounded"),
                  top_id.alias("source_id"))
    return (F.when(escalated, esc).when(top_score.isNull() | (top_score < F.lit(V.MIN_GROUNDED_SCORE)), none)
            .otherwise(ok))


# V9 ---------------------------------------------------------------------------
def draft_reply(suggestion: Column, source_ids: Column) -> Column:
    return F.struct(F.concat(F.lit(V.DRAFT_PREFIX), suggestion["answer"]).alias("draft"),
                    source_ids.alias("source_ids"), suggestion["grounded"].alias("grounded"))


# V10 --------------------------------------------------------------------------
def handoff_summary(query_type: Column, intent: Column, confidence: Column, priority: Column, sentiment: Column,
                    department: Column, entities: Column, verification_label: Column, reasons: Column,
                    policy_ids: Column) -> Column:
    """Labelled parts joined by '. ', empty parts omitted, trailing '.'."""
    from ..functions.text import pct
    ent_parts = [F.when(F.size(entities[f]) > 0, F.concat(F.lit(f.replace("_", " ") + ": "),
                                                         F.array_join(entities[f], ", ")))
                 for f in V.ENTITY_FIELDS]
    ents = F.concat_ws("; ", *ent_parts)
    parts = [
        F.concat(F.lit("Query type: "), F.replace(F.coalesce(query_type, F.lit("other")), F.lit("_"), F.lit(" "))),
        F.concat(F.lit("Predicted intent: "), F.replace(intent, F.lit("_"), F.lit(" ")), F.lit(" ("), pct(confidence),
                 F.lit(" confidence)")),
        F.concat(F.lit("Priority: "), priority),
        F.concat(F.lit("Sentiment: "), sentiment),
        F.concat(F.lit("Route: "), department),
        F.when(ents != "", F.concat(F.lit("Extracted references: "), ents)),
        F.when(verification_label.isNotNull(), F.concat(F.lit("Record lookup: "), verification_label)),
        F.when(F.size(reasons) > 0, F.concat(F.lit("Escalation reasons: "), F.array_join(reasons, "; "))),
        F.when(F.size(policy_ids) > 0, F.concat(F.lit("Retrieved policies: "), F.array_join(policy_ids, ", "))),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))

