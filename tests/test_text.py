from pyspark.sql import functions as F

from conftest import one_col
from ticketlens.functions import text as X


def col_values(spark, values, fn, dtype="string"):
    df = one_col(spark, values, dtype=dtype).withColumn("_i", F.monotonically_increasing_id())
    return [r.x for r in df.select("_i", fn(F.col("t")).alias("x")).orderBy("_i").collect()]


def test_normalize_collapses_unicode_whitespace(spark):
    got = col_values(spark, [None, "", "   ", "a  b\tc\n d ", "x y"], X.normalize_text)
    assert got == ["", "", "", "a b c d", "x y"]


def test_entities_quirks(spark):
    texts = [
        "order ORD-001234 and tracking TRK-000777",          # TRK- is read as an order id too (Q2)
        "what is the tracking number please",               # digit-free tracking id (Q3)
        "Payment TXN-123456 failed",                        # bare TXN: prefix consumed (Q4)
        "transaction TXN-123456 please",                    # lead-in keeps the whole id
        "I paid $1,250.00 yesterday on 12/05/2024",         # amount cut after two fraction digits
        "card ending 4242 and REFUND1234",                  # REF prefix excluded from orders
    ]
    df = one_col(spark, texts).withColumn("_i", F.monotonically_increasing_id())
    rows = df.select("_i", X.extract_entities(F.col("t")).alias("e")).orderBy("_i").collect()
    e = [r.e.asDict() for r in rows]
    assert e[0]["order_ids"] == ["ORD-001234", "TRK-000777"]
    assert e[0]["tracking_ids"] == ["TRK-000777"]
    assert e[1]["tracking_ids"] == ["please"]
    assert e[2]["transaction_ids"] == ["123456"]
    assert e[2]["order_ids"] == []
    assert e[3]["transaction_ids"] == ["TXN-123456"]
    assert e[4]["amounts"] == ["$1,25"]
    assert e[4]["dates"] == ["yesterday", "12/05/2024"]
    assert e[5]["card_references"] == ["4242"]
    assert e[5]["order_ids"] == []


def test_masking_rules_in_order(spark):
    texts = [
        "mail me at jane.doe+x@mail.example.org or call +1 415 555 0123",
        "account number: 12345678 please",
        "card 4111 1111 1111 1111 was used",
        "call +44 20 7946 0958 now",
        "ref ORD-1234567 vs ORD-123456",
    ]
    got = col_values(spark, texts, X.mask_sensitive)
    assert got[0] == "mail me at [EMAIL] or call [PHONE]"
    assert got[1] == "account [REDACTED] please"
    assert got[2] == "card [SENSITIVE_NUMBER] was used"
    assert got[3] == "call +[SENSITIVE_NUMBER] now"              # 12 digits: long-number rule runs first
    assert got[4] == "ref ORD-[PHONE] vs ORD-123456"          # Q5: 7 digits read as a phone
    again = col_values(spark, got, X.mask_sensitive)
    assert again == got                                       # idempotent on its own output


def test_mask_entities_keeps_last_four(spark):
    df = spark.createDataFrame([(["ORD-001234", "AB12"], ["TRK-9"], [], ["4242"], ["$5"], [])],
                               "o array<string>, t array<string>, x array<string>, c array<string>, "
                               "a array<string>, d array<string>")
    e = F.struct(F.col("o").alias("order_ids"), F.col("t").alias("tracking_ids"), F.col("x").alias("transaction_ids"),
                 F.col("c").alias("card_references"), F.col("a").alias("amounts"), F.col("d").alias("dates"))
    r = df.select(X.mask_entities(e).alias("m")).first().m
    assert r.order_ids == ["***1234", "[REDACTED]"]
    assert r.tracking_ids == ["***RK-9"]
    assert r.card_references == ["4242"]


def test_script_language_and_names(spark):
    texts = ["नमस्ते", "வணக்கம்", "hello there", "café", None]
    codes = col_values(spark, texts, X.script_language)
    assert codes == ["hi", "ta", "en", "unknown", "en"]
    names = col_values(spark, ["hi", "fr", "xx"], X.language_name)
    assert names == ["Hindi", "French", "Unknown language"]


def test_taxonomy_lookups(spark):
    assert col_values(spark, [" Track_Order ", "nonsense", None], X.query_type_for) == ["delivery", "other", "other"]
    assert col_values(spark, ["account_access", "x"], X.department_for) == ["Account Support", "General Support"]
    assert col_values(spark, ["technical_app_crash"], X.display_label) == ["Technical App Crash"]


def test_lexicon_sentiment_float_order(spark):
    four_five = "thanks good great helpful bad wrong late broken failed"
    two_three = "thanks good bad wrong late"
    got = col_values(spark, [four_five, two_three, "urgent. help", "great thanks"],
                     lambda c: X.polarity(X.lexicon_score(c)))
    assert got == ["neutral", "negative", "neutral", "positive"]   # Q6


def test_pct_half_even(spark):
    got = col_values(spark, [0.125, 0.45, 0.005, 1.0], X.pct, dtype="double")
    assert got == ["12%", "45%", "0%", "100%"]


def test_canon_ref(spark):
    assert col_values(spark, ["ord 00 1", None], X.canon_ref) == ["ORD001", ""]
