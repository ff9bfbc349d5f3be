"""Sources and sinks on small files."""
import json

import pytest
from pyspark.sql import functions as F

from ticketlens import vocab as V
from ticketlens.sources import io


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'text,intent\n"  hi  there ","\tpay_now \n"\nNA,x\nok then,NaN\n,y\n"multi\nline",other\nnull,z\n')
    rows = sorted((r.text, r.intent) for r in io.read_labelled(spark, p).collect())
    assert rows == [("hi there", "pay_now"), ("multi line", "other")]
    with pytest.raises(ValueError):
        io.read_labelled(spark, write(tmp_path / "b.csv", "text,intent\na b c,x\nd e f,x\n"))
    with pytest.raises(ValueError):
        io.read_labelled(spark, write(tmp_path / "c.csv", "text,label\na,x\n"))


def test_optional_sources_by_uri(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "text,intent\n1,x\n2,x\n3,x\n"), write(tmp_path / "b.csv", "text,query_type\n9,q\n")
    with pytest.warns(UserWarning):
        got = io.read_sources(spark, [a], [f"file://{b}", f"file://{tmp_path}/none.csv"]).collect()
    ordered = sorted(got, key=lambda r: (r.source_rank, r.source_file, r.row_id))
    assert [r.text for r in ordered] == ["1", "2", "3", "9"] and ordered[3].intent is None
    with pytest.raises(Exception):
        io.read_sources(spark, [f"{tmp_path}/missing.csv"]).collect()


def test_policies_and_records(spark, tmp_path):
    p = write(tmp_path / "p.json", json.dumps([{"id": "P2", "title": "T", "content": "c"}, {"id": "P1", "title": None, "content": "d"}]))
    rows = io.read_policies(spark, p).orderBy("policy_idx").collect()
    assert [(r.policy_id, r.search_text) for r in rows] == [("P2", "T c"), ("P1", "d")]
    r = write(tmp_path / "r.json", json.dumps({"orders": [{"reference": "ORD-1", "tracking_reference": "TRK-1", "status": "delivered"}],
                                               "transactions": [{"reference": "TXN-1", "status": "settled"}]}))
    got = sorted((x.reference or "", x.transaction_reference or "", x.order_status or x.transaction_status) for x in io.read_records(spark, r).collect())
    assert got == [("", "TXN-1", "settled"), ("ORD-1", "", "delivered")]


def test_public_corpus_keeps_the_first_label_of_a_text(spark):
    corpus = spark.createDataFrame([(2, "a", "L2"), (1, "a", "L1"), (3, "b", "zz"), (4, "c", "L2")], "Row int, Instruction string, Intent string")
    labels = spark.createDataFrame([("L1", "payment", "p1"), ("L2", "refund", "r1")], "source_label string, query_type string, intent string")
    assert sorted(tuple(r) for r in io.ingest_public(corpus, labels, rank=["Row"]).collect()) == [("a", "payment", "p1"), ("c", "refund", "r1")]
    assert io.ingest_public(corpus, labels).count() == 2
    with pytest.raises(ValueError):
        io.ingest_public(corpus.drop("Intent"), labels)


def test_label_ids_outside_the_list(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (None,)], "label int")
    assert [r.label_name for r in io.decode_labels(df, ["a", "b"]).collect()] == [None, "a", "b", None, None]


def test_truth_booleans(spark, tmp_path):
    p = write(tmp_path / "t.csv", "message,expected_escalation\na, TRUE\nb,no\nc,true \n")
    assert [r.expected_escalation for r in io.read_truth(spark, p).collect()] == [True, False, True]


def test_attachments(spark, tmp_path):
    d = tmp_path / "att"
    d.mkdir()
    (d / "ok.txt").write_bytes(b"hello  there\n")
    (d / "bad.txt").write_bytes(b"caf\xe9 and \xff more")
    (d / "big.txt").write_bytes(b"x" * (V.MAX_ATTACHMENT_BYTES + 1))
    (d / "long.TXT").write_bytes(b"y" * 6000)
    (d / "tiny.txt").write_bytes(b"a ")
    (d / "doc.pdf").write_bytes(b"%PDF")
    (d / "tool.exe").write_bytes(b"MZ")
    ok, bad = io.ingest_attachments(spark, str(d))
    got = {r.filename: r.text for r in ok.collect()}
    assert got["ok.txt"] == "hello there" and got["bad.txt"] == "caf� and � more" and len(got["long.TXT"]) == V.MAX_MESSAGE_CHARS
    assert {r.filename: r.reject_code for r in bad.collect()} == {"big.txt": 413, "tiny.txt": 422, "doc.pdf": 422, "tool.exe": 415}


def test_metrics_round_trip_by_uri(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    empty = io.read_metrics(spark, path, ["a"], ["acc"]).collect()
    assert [tuple(r) for r in empty] == [("a", None)]
    io.write_metrics(spark.createDataFrame([("a", "acc", 1), ("b", "f1", 2)], "component string, metric string, value int"), path)
    got = {r.component: (r.acc, r.f1) for r in io.read_metrics(spark, path, ["a", "b", "c"], ["acc", "f1"]).collect()}
    assert got == {"a": (1.0, None), "b": (None, 2.0), "c": (None, None)}


def test_feedback_store_predictions(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "ticket_id long, reviewed_at string")
    io.write_feedback_csv(e, f"{tmp_path}/fb")
    assert [r.ticket_id for r in spark.read.csv(f"{tmp_path}/fb", header=True).collect()] == ["2", "1"]
    rows = spark.createDataFrame([(1, "m")], "ticket_id long, message string")
    for _ in range(2):
        io.append_tickets(rows, rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/tickets").count() == spark.read.parquet(f"{tmp_path}/out/events").count() == 2
    io.write_predictions(spark.createDataFrame([(1, "x"), (2, "y")], "id int, truth string"), spark.createDataFrame([(1, "x")], "id int, pred string"), "id", f"{tmp_path}/p")
    assert sorted((r.id, r.pred) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "x"), (2, None)]


def test_append_shows_whole_batches_only(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/store"
    assert io.read_appended(spark, out, "tickets") is None
    make = lambda ids: spark.createDataFrame([(i, "m") for i in ids], "ticket_id long, text string")
    ids = lambda t: sorted(r.ticket_id for r in io.read_appended(spark, out, t).collect())
    io.append_tickets(make([1, 2]), make([1, 2]), out, "first")

    broken = make([3]).select("ticket_id", F.raise_error(F.lit("lost")).cast("string").alias("text"))
    with pytest.raises(Exception, match="lost"):
        io.append_tickets(make([3]), broken, out, "7")       # the tickets are written, the events are not
    assert ids("tickets") == ids("events") == [1, 2]
    io.append_tickets(make([3]), make([3]), out, "7")        # the retry
    io.append_tickets(make([3, 4]), make([3, 4]), out, "7")  # delivered once more: it is listed already
    assert ids("tickets") == ids("events") == [1, 2, 3]
    assert io.append_tickets(make([9]), make([9]), out) not in ("first", "7")
    assert ids("tickets") == ids("events") == [1, 2, 3, 9]
    with pytest.raises(ValueError):
        io.append_tickets(make([5]), make([5]), out, "../x")


def test_older_table_gains_columns(spark):
    d = io.evolve_schema(spark.createDataFrame([(1,)], "id int"), {"n": ("bigint", 0), "note": ("string", None), "id": ("int", 9)})
    assert d.dtypes == [("id", "int"), ("n", "bigint"), ("note", "string")] and tuple(d.first()) == (1, 0, None)


def test_files_of_several_schemas_are_read_as_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{path}/a=1")
    spark.createDataFrame([(2, 5), (3, None)], "id int, n int").write.parquet(f"{path}/a=2")
    spark.createDataFrame([("x", 4)], "note string, id int").write.parquet(f"{path}/a=3")
    defaults = {"n": ("bigint", 0), "note": ("string", None), "status": ("string", "open")}
    got = io.read_evolved(spark, path, defaults)
    assert dict(got.dtypes) == {"id": "int", "n": "bigint", "note": "string", "status": "string", "a": "int"}
    assert sorted((r.id, r.n, r.note, r.status) for r in got.collect()) == [(1, 0, None, "open"), (2, 5, None, "open"), (3, 0, None, "open"), (4, 0, "x", "open")]
    assert io.read_evolved(spark, f"{path}/a=1", {}).columns == ["id"]


def test_field_bounds(spark):
    rows = [("ok then", "open", None, "Support agent"), ("ok then", "closed", None, "ab"), ("ok then", "open", "x" * 2001, "ab"),
            ("ok then", "open", "r", "a"), ("no", "open", None, "ab"), ("ok then", None, None, "ab")]
    df = spark.createDataFrame(rows, "message string, status string, reply string, reviewer string")
    ok, bad = io.split_valid(df, status="status", lengths={k: V.FIELD_LENGTHS[k] for k in ("reply", "reviewer")})
    assert ok.count() == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["invalid_status", "invalid_status", "message_too_short", "reply_too_long", "reviewer_too_short"]


def test_feedback_frame_blank_fields(spark):
    rev = spark.createDataFrame([(1, None, None, "ann", None)], "ticket_id long, final_query_type string, final_intent string, reviewer string, notes string") \
        .withColumn("reviewed_at", F.lit("2024-02-03 04:05:06").cast("timestamp_ntz"))
    store = spark.createDataFrame([(1, "m", "payment", "p", "open"), (2, "n", "refund", "r", "open")],
                                  "ticket_id long, message string, query_type string, pred_intent string, status string")
    r = io.feedback_export_frame(rev, store).collect()
    assert len(r) == 1 and (r[0].final_query_type, r[0].notes, r[0].reviewed_at) == ("", "", "2024-02-03 04:05:06.000000")
