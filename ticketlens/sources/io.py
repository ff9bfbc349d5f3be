"""Sources and sinks (S family)."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import normalize_text, strip
from ..operators.prep import _missing
from ..session import path_exists


# S10 --------------------------------------------------------------------------
def feedback_export_frame(reviews: DataFrame, store: DataFrame) -> DataFrame:
    """Reviewed labels joined to their tickets (orphans skipped), the ten export
    columns, nulls as empty text where the export writes ''."""
    j = reviews.join(store, on="ticket_id", how="inner")
    return j.select(
        "ticket_id",
        F.col("message").alias("customer_message"),
        F.col("query_type").alias("predicted_query_type"),
        F.col("pred_intent").alias("predicted_intent"),
        F.coalesce(F.col("final_query_type"), F.lit("")).alias("final_query_type"),
        F.coalesce(F.col("final_intent"), F.lit("")).alias("final_intent"),
        "reviewer",
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        "status",
        F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reviewed_at"),
    )


def write_feedback_csv(export: DataFrame, path: str) -> None:
    """Newest review first; one CSV part per partition (no single-task funnel)."""
    (export.orderBy(F.col("reviewed_at").desc(), F.col("ticket_id"))
     .write.mode("overwrite").option("header", True).csv(path))


# S1 ---------------------------------------------------------------------------
def read_labelled(spark, path: str, text: str = "text", label: str = "intent") -> DataFrame:
    """Labelled CSV: rows with a missing text or label dropped (empty cells and the
    usual not-available tokens), text normalised, label stripped of white space of
    any kind; at least two labels required (one aggregate checks it)."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {text, label} - set(df.columns)
    if missing:
        raise ValueError(f"{path}: columns {sorted(missing)} not found")
    there = ~_missing(F.col(text)) & ~_missing(F.col(label))
    out = df.where(there).withColumn(text, normalize_text(F.col(text))).withColumn(label, strip(F.col(label)))
    if out.select(label).distinct().limit(2).count() < 2:
        raise ValueError(f"{path}: a classifier needs two labels or more")
    return out


# S2 ---------------------------------------------------------------------------
def read_sources(spark, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Union of several labelled CSVs by column name (missing columns null); an
    optional source whose path names nothing is skipped with a warning (asked of
    the path's own file system).  (source_rank, source_file, row_id) is the input
    order for later keep-first de-duplication: a multi-line CSV is never split, so
    row_id, taken in the task that reads the file, follows the rows of a file."""
    import warnings
    parts = []
    for rank, path in enumerate(list(required) + list(optional)):
        if path in optional and not path_exists(spark, path):
            warnings.warn(f"optional source not found: {path}")
            continue
        d = spark.read.csv(path, header=True, multiLine=True, escape='"')
        parts.append(d.withColumn("source_rank", F.lit(rank)).withColumn("source_file", F.input_file_name())
                     .withColumn("row_id", F.monotonically_increasing_id()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# S3 ---------------------------------------------------------------------------
def read_policies(spark, path: str) -> DataFrame:
    """Policy documents (JSON array of {id, title, content}); search text is
    title + ' ' + content; policy_idx keeps file order for tie-breaking (one
    array is one record of one task, numbered there before anything moves)."""
    p = spark.read.json(path, multiLine=True).withColumn("policy_idx", F.monotonically_increasing_id())
    return p.select(F.col("id").alias("policy_id"), "title", "content", "policy_idx", F.concat_ws(" ", "title", "content").alias("search_text"))


# S4 ---------------------------------------------------------------------------
def read_records(spark, path: str) -> DataFrame:
    """Nested operational records JSON -> one records table in the fixture
    shape (order, tracking and transaction references with statuses)."""
    raw = spark.read.json(path, multiLine=True)
    orders = raw.select(F.explode("orders").alias("o")).select("o.*")
    txns = raw.select(F.explode("transactions").alias("t")).select("t.*")
    o = orders.select(F.col("reference"), F.col("tracking_reference"), F.col("status").alias("order_status"))
    t = txns.select(F.col("reference").alias("transaction_reference"), F.col("status").alias("transaction_status"))
    # Orders and transactions are separate lookups: union them into the record
    # shape with the missing side null.
    return (o.withColumn("transaction_reference", F.lit(None).cast("string"))
            .withColumn("transaction_status", F.lit(None).cast("string"))
            .unionByName(t.withColumn("reference", F.lit(None).cast("string"))
                         .withColumn("tracking_reference", F.lit(None).cast("string"))
                         .withColumn("order_status", F.lit(None).cast("string"))))


# S5 ---------------------------------------------------------------------------
def ingest_public(df: DataFrame, label_map: DataFrame, text: str = "instruction", label: str = "intent",
                  rank: list[str] | None = None) -> DataFrame:
    """Public corpus: lower-case column names, required columns, map the source
    label to (query_type, intent) by an inner join (unmapped rows drop), then one
    row per text: the first by ``rank`` (columns of the input), by label without."""
    from ..operators.prep import dedupe
    d = df.toDF(*[c.lower() for c in df.columns])
    if not {text, label}.issubset(d.columns):
        raise ValueError(f"columns {text} and {label} are needed, found {d.columns}")
    order = [F.col(c.lower()).alias(f"_rank{i}") for i, c in enumerate(rank or [label])]
    m = label_map.select(F.col("source_label").alias("_source"), "query_type", F.col("intent").alias("_intent"))
    j = d.select(F.col(text).alias("_text"), F.col(label).alias("_label"), *order).join(m, F.col("_label") == F.col("_source"))
    rows = j.select(F.col("_text").alias("text"), "query_type", F.col("_intent").alias("intent"), *[f"_rank{i}" for i in range(len(order))])
    return dedupe(rows, "text", [f"_rank{i}" for i in range(len(order))] + ["query_type", "intent"]).select("text", "query_type", "intent")


# S6 ---------------------------------------------------------------------------
def decode_labels(df: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Integer class ids -> names (ids outside the list stay null)."""
    arr = F.array(*[F.lit(n) for n in names])
    return df.withColumn(f"{label}_name", F.get(arr, F.col(label).cast("int")))


# S7 ---------------------------------------------------------------------------
def read_truth(spark, path: str, bool_cols: tuple[str, ...] = ("expected_escalation",)) -> DataFrame:
    """Evaluation truth CSV; boolean columns parsed as lower-cased text == 'true'."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for c in bool_cols:
        if c in d.columns:
            d = d.withColumn(c, F.lower(strip(F.col(c))) == F.lit("true"))
    return d


# S8 ---------------------------------------------------------------------------
def ingest_attachments(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Text attachments: allow-listed extension, at most 2 MiB, UTF-8 decoded
    with replacement, whitespace collapsed, cut to 5000 characters, at least 3
    characters.  Returns (accepted, rejected with HTTP-style reason code).
    PDF and DOCX need per-row codecs and are rejected as unreadable (422)."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")
    readable = (ext == "txt") & (F.col("length") <= V.MAX_ATTACHMENT_BYTES)   # others are never opened
    reason = (F.when(~ext.isin(*V.ATTACHMENT_EXTENSIONS), F.lit(415))
              .when(F.col("length") > V.MAX_ATTACHMENT_BYTES, F.lit(413)).otherwise(F.lit(422)))
    closed = files.where(~readable).select(name, ext.alias("extension"), F.lit(None).cast("string").alias("text"), reason.alias("reject_code"))
    text = F.substring(normalize_text(F.make_valid_utf8(F.col("content").cast("string"))), 1, V.MAX_MESSAGE_CHARS)
    opened = files.where(readable).select(name, ext.alias("extension"), text.alias("text"))
    opened = opened.withColumn("reject_code", F.when(F.length("text") < 3, F.lit(422)))
    return (opened.where(F.col("reject_code").isNull()).drop("reject_code"),
            opened.where(F.col("reject_code").isNotNull()).unionByName(closed))


# S9 ---------------------------------------------------------------------------
def append_tickets(store_rows: DataFrame, events: DataFrame, out_dir: str, batch_id: str | None = None) -> str:
    """Append masked tickets and their 'received' events as one batch; returns its id.

    Both tables are written under the batch's id, and the batch is listed after
    both are complete.  Readers (``read_appended``) see listed batches only, so a
    failure in between shows nothing, and a retry with the same id overwrites what
    was left.  A listed batch is not written again."""
    spark = store_rows.sparkSession
    batch = batch_id or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    if not path_exists(spark, f"{out_dir}/batches/{batch}/_SUCCESS"):
        store_rows.write.mode("overwrite").parquet(f"{out_dir}/tickets/batch_id={batch}")
        events.write.mode("overwrite").parquet(f"{out_dir}/events/batch_id={batch}")
        spark.createDataFrame([(batch,)], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batches/{batch}")
    return batch


def read_appended(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """``tickets`` or ``events`` of all listed batches, with ``batch_id``; None before the first one."""
    if not path_exists(spark, f"{out_dir}/batches/*/_SUCCESS"):
        return None
    listed = spark.read.schema("batch_id string").parquet(f"{out_dir}/batches/*")
    rows = spark.read.option("basePath", f"{out_dir}/{table}").parquet(f"{out_dir}/{table}")
    return rows.withColumn("batch_id", F.col("batch_id").cast("string")).join(listed, "batch_id", "left_semi")


# S11 ----------------------------------------------------------------------------
def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics long table (component, metric, value) as JSON lines."""
    metrics.select("component", "metric", F.col("value").cast("double")).write.mode("overwrite").json(path)


def read_metrics(spark, path: str, components: list[str], metrics: list[str]) -> DataFrame:
    """Wide view: one row per component, one column per metric asked for (null
    where there is none, also where the path does not exist yet)."""
    comps = spark.createDataFrame([(c,) for c in components], "component string")
    if not path_exists(spark, path):
        return comps.select("component", *[F.lit(None).cast("double").alias(m) for m in metrics])
    m = spark.read.schema("component string, metric string, value double").json(path)
    wide = m.groupBy("component").pivot("metric", metrics).agg(F.first("value"))
    return comps.join(wide, on="component", how="left")


# S12 ----------------------------------------------------------------------------
def write_predictions(truth: DataFrame, predictions: DataFrame, key: str, path: str) -> None:
    truth.join(predictions, on=key, how="left").write.mode("overwrite").parquet(path)


# S13 ----------------------------------------------------------------------------
def evolve_schema(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add store columns that an older table lacks: {name: (type, default)}."""
    for name, (dtype, default) in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(dtype))
    return df


def read_evolved(spark: SparkSession, path: str, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """A table whose files were written under older and newer schemas: the files' schemas are merged on read, a column
    that no file has is added, and rows without a value get the default."""
    df = evolve_schema(spark.read.option("mergeSchema", "true").parquet(path), defaults)
    filled = {name: F.coalesce(F.col(name), F.lit(default).cast(dtype)).cast(dtype) for name, (dtype, default) in defaults.items()}
    return df.withColumns(filled) if filled else df


# S14 ----------------------------------------------------------------------------
def split_valid(df: DataFrame, message: str = "message", status: str | None = None,
                lengths: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Intake validation: message 3..5000 characters, status in the enum, and the
    bounds of optional fields (``V.FIELD_LENGTHS`` for an agent's update; a null
    field passes).  Returns (valid, rejected with reason)."""
    n = F.length(F.col(message))
    reason = (F.when(F.col(message).isNull() | (n < V.MIN_MESSAGE_CHARS), F.lit("message_too_short"))
              .when(n > V.MAX_MESSAGE_CHARS, F.lit("message_too_long")))
    if status:
        reason = reason.when(F.col(status).isNull() | ~F.col(status).isin(*V.TICKET_STATUSES), F.lit("invalid_status"))
    for field, (least, most) in (lengths or {}).items():
        reason = reason.when(F.length(F.col(field)) < least, F.lit(f"{field}_too_short")) \
            .when(F.length(F.col(field)) > most, F.lit(f"{field}_too_long"))
    d = df.withColumn("reject_reason", reason)
    return d.where(F.col("reject_reason").isNull()).drop("reject_reason"), d.where(F.col("reject_reason").isNotNull())
