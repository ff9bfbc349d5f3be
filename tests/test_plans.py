"""Plan shape of every registered query: no Python in tasks but where it is listed, no cartesian
product or nested-loop join, and the flagship scan prunes columns."""
import __spark_entry__ as E
from ticketlens.plans import catalog

SF = "/root/testdata/sf0.001"
BANNED = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas")
#: Matrix products in tasks.
PYTHON = {"vector_search": "MapInArrow"}
# Iterative model training has no SQL equivalent: rows-only check plus test_model.py.
ROWS_ONLY = {"intent_model_eval", "calibrated_model_eval"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_queries_plans(spark):
    for name, fn in catalog.SPARK.items():
        if name in ROWS_ONLY:  # they train while the plan is made
            continue
        text = plan_text(fn(spark, SF))
        for bad in BANNED:
            assert bad not in text or PYTHON.get(name) == bad, f"{name}: {bad} in plan"


def test_every_query_has_oracle_or_is_listed():
    missing = set(catalog.SPARK) - set(catalog.SQL) - ROWS_ONLY
    assert not missing, missing


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"priority", "department", "escalate_to_human", "n_tickets"}
    assert sum(r.n_tickets for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_ticket_scan_reads_only_needed_columns(spark):
    from ticketlens.plans import fixtures as fx
    text = fx.tickets(spark, SF).select("ticket_id", "message")._jdf.queryExecution().executedPlan().toString()
    assert "value" not in text.split("ReadSchema")[1].split("\n")[0]
