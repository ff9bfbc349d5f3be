from pyspark.sql import functions as F

from ticketlens.functions import rules as R


def decide_rows(spark, rows):
    df = spark.createDataFrame(rows, "query_type string, intent string, confidence double, sentiment string, "
                                     "text string, qconf double")
    d = df.select(R.decide(F.col("query_type"), F.col("intent"), F.col("confidence"), F.col("sentiment"),
                           F.col("text"), F.col("qconf")).alias("d"))
    return [r.d for r in d.collect()]


def test_reference_rule_cases(spark):
    rows = [
        ("payment", "payment_issue", 0.9, "neutral", "Someone made a fraudulent purchase with my card", None),
        ("payment", "payment_issue", 0.9, "neutral", "I don't recognize the charge on my statement", None),
        ("other", "general_complaint", 0.9, "neutral", "Please let me talk to a human about this", None),
        ("delivery", "delivery_delay", 0.2, "neutral", "Where is my parcel", None),
        ("delivery", "delivery_delay", 0.2, "neutral", "Where is my parcel", 0.8),
        ("other", "product_information", 0.9, "positive", "Great product, thanks", None),
    ]
    d = decide_rows(spark, rows)
    assert (d[0].priority, d[0].escalate_to_human) == ("critical", True)
    assert d[0].department == "Human Escalation Queue"
    assert (d[1].priority, d[1].escalate_to_human) == ("critical", True)
    assert d[2].escalate_to_human and "Customer explicitly requested a human agent" in d[2].escalation_reasons
    assert d[3].escalate_to_human and d[3].escalation_reasons == ["Low routing confidence (intent 20%)"]
    assert not d[4].escalate_to_human and d[4].department == "Logistics Support"
    assert (d[5].priority, d[5].escalate_to_human) == ("low", False)
    assert d[5].explanation[0] == "Fine-intent classifier selected 'product_information' with 90% confidence."


def test_rule_edges(spark):
    rows = [
        ("payment", "payment_issue", 0.9, "neutral", "I don’t recognize this charge", None),   # Q17 curly quote
        ("payment", "payment_methods", 0.9, "neutral", "which cards do you take", None),           # routine -> low
        ("other", "general_complaint", 0.45, "negative", "bad service", None),                     # 0.45 is not < 0.45
        ("delivery", "missing_delivery", 0.9, "neutral", "it was delivered but the box is missing", None),
    ]
    d = decide_rows(spark, rows)
    assert d[0].priority == "medium"
    assert d[1].priority == "low"
    assert d[2].priority == "medium" and not d[2].escalate_to_human
    assert d[3].priority == "high"


def test_clarification(spark):
    df = spark.createDataFrame([
        ("track_order", [], [], [], [], "where is it"),
        ("refund_pending", [], [], ["TXN-1"], [], "refund"),
        ("technical_app_crash", [], [], [], [], "it happened again"),       # Q7: 'app' inside 'happened'
        ("technical_app_crash", [], [], [], [], "it keeps freezing"),
    ], "intent string, o array<string>, t array<string>, x array<string>, c array<string>, text string")
    e = F.struct(F.col("o").alias("order_ids"), F.col("t").alias("tracking_ids"),
                 F.col("x").alias("transaction_ids"), F.col("c").alias("card_references"))
    q = [r.q for r in df.select(R.clarification(F.col("intent"), e, F.col("text")).alias("q")).collect()]
    assert q[0].startswith("Please share your order ID")
    assert q[1] is None
    assert q[2] is None
    assert q[3].startswith("Which app, website")
