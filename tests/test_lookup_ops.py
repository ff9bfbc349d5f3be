from pyspark.sql import functions as F

from ticketlens.operators import lookup, ops
from ticketlens.functions.text import extract_entities


def test_verification_outcomes(spark):
    tickets = spark.createDataFrame([
        (1, "nothing to check here"),
        (2, "order ORD-000001 and tracking number TRK-000001"),
        (3, "order ORD-000001 and order ORD-999999"),
    ], "ticket_id long, message string").withColumn("entities", extract_entities(F.col("message")))
    records = spark.createDataFrame([(1, "ORD-000001", "TRK-000001", "TXN-000001", "delivered", "settled")],
                                    "order_key long, reference string, tracking_reference string, "
                                    "transaction_reference string, order_status string, transaction_status string")
    v = {r.ticket_id: r for r in lookup.verify_tickets(tickets, records).collect()}
    assert v[1].verification_status == "no_reference_provided" and not v[1].requires_manual_verification
    # TRK-000001 is read as an order id too and is not an order reference (Q2).
    assert v[2].verification_status == "reference_not_found" and v[2].n_checked == 3
    assert [c.ref_type for c in v[2].checked_references] == ["order", "order", "tracking"]
    assert v[3].n_missing == 1


def test_lifecycle_fold(spark):
    tickets = spark.createDataFrame([(1, "open"), (2, "open")], "ticket_id long, status string") \
        .withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    upd = spark.createDataFrame([
        (10, 1, "2024-01-01 01:00:00", "resolved", "refund_request", "done", "a1"),
        (11, 1, "2024-01-01 02:00:00", "open", None, None, "a2"),
    ], "update_id long, ticket_id long, updated_at string, status string, final_intent string, outcome string, "
       "reviewer string").withColumn("updated_at", F.col("updated_at").cast("timestamp")) \
        .withColumn("final_query_type", F.lit(None).cast("string"))
    st = {r.ticket_id: r for r in ops.apply_updates(tickets, upd).collect()}
    assert st[1].status == "open" and st[1].agent_outcome is None       # null overwrite (L1)
    assert st[2].status == "open" and st[2].n_updates == 0
    rv = ops.upsert_reviews(upd).collect()
    assert len(rv) == 1 and rv[0].reviewer == "a1" and str(rv[0].reviewed_at).startswith("2024-01-01 01:00")
    ev = ops.ticket_events(tickets, upd)
    cur = {r.ticket_id: r.current_status for r in ops.current_status(ev).collect()}
    assert cur == {1: "open", 2: "received"}
