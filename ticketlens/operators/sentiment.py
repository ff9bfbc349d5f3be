"""Valence sentiment over a lexicon table (B20) with the source of the score.

Words are what stands between white space, without punctuation at either end
(a token of which one or two characters would be left stays whole).  A word of the
caller's lexicon (term, valence) has its valence, which its context changes, in
this order:

1. a "no" up to two words before (three with "or" or "nor" in front) turns it, and
   a "no" before a lexicon word has no valence itself;
2. capitals raise it where some words, but not all, are in capitals;
3. each of the three words before that is no lexicon word, the nearest first, may
   raise or lower it as a booster (less with distance), and turns it as a negation;
   "never so" and "never this" raise it, and "without doubt" leaves it;
4. "least" before it turns it, but for "at least" and "very least".

Boosters have no valence, nor has "kind" in "kind of".  Before the first "but"
valences count half, behind it one and a half times.  Exclamation marks (four at
most) and several question marks add to the sum in its direction, which is
squashed into -1..1 by s / sqrt(s * s + 15).  Idioms and emoticon descriptions of
the public implementation are not part of it: a lexicon may hold emoticons as
words.  Null and empty texts score 0.

Without a lexicon the word-list score of ``functions.text`` stands in, and
``sentiment_source`` says which ran.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import lexicon_score, normalize_text, polarity

# FIXED VALUES of the public valence method.
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite")
RAISING = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "effing", "enormous", "enormously",
    "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking",
    "fricking", "frickin", "frigging", "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very")
LOWERING = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly",
    "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta", "sortof", "sort-of")
BOOST, CAPITALS, NEGATION_FACTOR, NEVER_SO = 0.293, 0.733, -0.74, 1.25
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, EXCLAMATIONS, QUESTION, QUESTIONS = 0.292, 4, 0.18, 0.96
SQUASH = 15.0
VALENCE_SOURCE = "valence lexicon"
ENDS = "^\\p{Punct}+|\\p{Punct}+$"


def _among(word: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def _toward(v: Column, by: float) -> Column:
    """``by`` in the direction of v."""
    return F.when(v > 0, F.lit(by)).otherwise(F.lit(-by))


def valence_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """id, sentiment_score (4 dp), sentiment, sentiment_source for every row; ids are unique."""
    clean = normalize_text(F.col(text))
    tokens = F.array_remove(F.split(clean, " "), "")

    def word(t: Column) -> Column:
        inner = F.regexp_replace(t, ENDS, "")
        return F.when(F.length(inner) <= 2, t).otherwise(inner)
    base = df.select(F.col(id_col).alias("id"), F.transform(tokens, word).alias("w"), F.regexp_count(clean, F.lit("!")).alias("_e"),
                     F.regexp_count(clean, F.lit("\\?")).alias("_q"))
    capital = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    n_caps = F.size(F.filter("w", capital))
    rows = base.select("id", (F.size("w") > n_caps).alias("_some"), F.posexplode("w").alias("pos", "word")).withColumn("_caps", capital(F.col("word")))
    rows = rows.withColumn("term", F.lower("word"))
    terms = lexicon.groupBy("term").agg(F.max(F.col("valence").cast("double")).alias("valence"))
    rows = rows.join(terms, "term", "left")

    at = Window.partitionBy("id").orderBy("pos")
    known = F.col("valence").isNotNull()
    some = F.col("_some")
    near = rows.select("id", "pos", "term", "valence", (F.col("_caps") & some).alias("caps"),
                       *[F.lag("term", k).over(at).alias(f"t{k}") for k in (1, 2, 3)],
                       *[F.lag(known, k).over(at).alias(f"k{k}") for k in (1, 2, 3)],
                       *[F.lag(F.col("_caps") & some, k).over(at).alias(f"c{k}") for k in (1, 2, 3)],
                       F.lead("term").over(at).alias("next"), F.lead(known).over(at).alias("next_known"),
                       F.min(F.when(F.col("term") == "but", F.col("pos"))).over(Window.partitionBy("id")).alias("but"))
    idle = _among(F.col("term"), RAISING + LOWERING) | F.coalesce((F.col("term") == "kind") & (F.col("next") == "of"), F.lit(False))
    v = near.where(known & ~idle)

    t1, t2, t3 = (F.col(f"t{k}") for k in (1, 2, 3))
    no = _among(t1, ("no",)) | _among(t2, ("no",)) | (_among(t3, ("no",)) & _among(t1, ("or", "nor")))
    first = F.when((F.col("term") == "no") & F.coalesce("next_known", F.lit(False)), F.lit(0.0)).otherwise(F.col("valence"))
    v = v.withColumn("v", F.when(no, F.col("valence") * NEGATION_FACTOR).otherwise(first))
    v = v.withColumn("v", F.when(F.col("caps"), F.col("v") + _toward(F.col("v"), CAPITALS)).otherwise(F.col("v")))
    for k in (1, 2, 3):
        w, here = F.col(f"t{k}"), F.col(f"t{k}").isNotNull() & ~F.coalesce(F.col(f"k{k}"), F.lit(False))
        raising, lowering = _among(w, RAISING), _among(w, LOWERING)
        side = F.when(F.col("v") < 0, -1.0).otherwise(1.0) * F.when(raising, BOOST).otherwise(-BOOST)
        loud = F.when(F.coalesce(F.col(f"c{k}"), F.lit(False)), _toward(F.col("v"), CAPITALS)).otherwise(0.0)
        v = v.withColumn("v", F.when(here & (raising | lowering), F.col("v") + (side + loud) * DISTANCE[k - 1]).otherwise(F.col("v")))
        negated = _among(w, NEGATIONS) | F.coalesce(w.contains("n't"), F.lit(False))
        turned = F.when(negated, F.col("v") * NEGATION_FACTOR).otherwise(F.col("v"))
        if k > 1:
            so = _among(t1, ("so", "this")) | (_among(t2, ("so", "this")) if k == 3 else F.lit(False))
            doubt = _among(t1, ("doubt",)) | (_among(t2, ("doubt",)) if k == 3 else F.lit(False))
            turned = F.when((w == "never") & so, F.col("v") * NEVER_SO).when((w == "without") & doubt, F.col("v")).otherwise(turned)
        v = v.withColumn("v", F.when(here, turned).otherwise(F.col("v")))
    least = _among(t1, ("least",)) & ~F.coalesce("k1", F.lit(False)) & ~_among(t2, ("at", "very"))
    v = v.withColumn("v", F.when(least, F.col("v") * NEGATION_FACTOR).otherwise(F.col("v")))
    part = F.when(F.col("pos") < F.col("but"), BEFORE_BUT).when(F.col("pos") > F.col("but"), AFTER_BUT).otherwise(1.0)
    total = v.groupBy("id").agg(F.sum(F.col("v") * part).alias("s"))

    more = F.least("_e", F.lit(EXCLAMATIONS)) * EXCLAMATION + F.when(F.col("_q") > 3, QUESTIONS).when(F.col("_q") > 1, F.col("_q") * QUESTION).otherwise(0.0)
    out = base.select("id", more.alias("more")).join(total, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    s = F.when(F.col("s") > 0, F.col("s") + F.col("more")).when(F.col("s") < 0, F.col("s") - F.col("more")).otherwise(0.0)
    scored = out.withColumn("s", s).select(F.col("id").alias(id_col), F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + SQUASH), 4).alias("sentiment_score"))
    return scored.withColumn("sentiment", polarity("sentiment_score")).withColumn("sentiment_source", F.lit(VALENCE_SOURCE))


def analyse(df: DataFrame, id_col: str, text: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Valence sentiment where a lexicon is given, the word lists otherwise."""
    if lexicon is not None:
        return valence_sentiment(df, id_col, text, lexicon)
    scored = df.select(id_col, lexicon_score(F.col(text)).alias("sentiment_score"))
    return scored.withColumn("sentiment", polarity("sentiment_score")).withColumn("sentiment_source", F.lit(V.LEXICON_SOURCE))
