"""Plan checks: built-in expressions only, filters and columns pushed into the scan."""

import pytest

import __spark_entry__ as se
from tessera.plans import scrub as j1
from tessera.plans import usage as j5

SF = "/root/testdata/sf0.001"
NO_SIDE_EFFECTS = ["scrub_customer", "scrub_documents", "scrub_customer_sql", "stale_orders", "usage_totals", "supplier_dependency",
                   "nation_dependency", "nation_dependency_json", "row_report_customer",
                   "profile_orders"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_SIDE_EFFECTS)
def test_no_python_in_plan(spark, name):
    plan = plan_of(se.queries()[name](spark, SF))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scrub_is_one_stage_and_prunes(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    df = j1.scrub(j1.customer_input(c))
    plan = plan_of(df)
    assert "Exchange" not in plan
    assert "c_acctbal" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_usage_day_filter_pushed(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    plan = plan_of(j5.events_table(ev))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in plan and "LessThan(ts,2024-" in plan


def test_stale_orders_pushes_line_status(spark):
    plan = plan_of(se.queries()["stale_orders"](spark, SF))
    assert "EqualTo(l_linestatus,O)" in plan


def test_upsert_against_bucketed_base_shuffles_only_the_batch(spark):
    from tessera.operators import upsert
    from tessera.sinks import write_bucketed

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    spark.sql("CREATE DATABASE IF NOT EXISTS tplan")
    write_bucketed(orders, "tplan.orders_b", "o_orderkey", 8)
    base = spark.table("tplan.orders_b")
    batch = orders.filter("o_orderstatus = 'O'").withColumn("seq", orders.o_orderkey * 0)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                                "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        out = upsert(base, batch, ["o_orderkey"], order_by=["seq"])
        plan = plan_of(out).splitlines()
        scan = [i for i, line in enumerate(plan) if "Bucketed: true" in line]
        assert scan, "base should be read as a bucketed scan"
        # the base is fed to the join straight from its bucketed files (no exchange above the scan)
        assert "Exchange" not in plan[scan[0] - 1] and "SortMergeJoin" in plan[scan[0] - 2]
        assert out.count() == orders.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
