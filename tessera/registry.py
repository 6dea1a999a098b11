"""Registered queries over the test tables, and their SQL twins (DuckDB dialect).

Each query takes ``(spark, sf_dir)`` and reads whole tables from ``{sf_dir}/{name}.parquet``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sql as fsql
from tessera.functions.paths import basename
from tessera.functions.text import EMAIL_PATTERN, hash_value
from tessera.operators.aggregates import daily_average, row_count, status_counts
from tessera.operators.filters import not_in
from tessera.operators.inspect import profile
from tessera.operators.joins import add_row_index, unreferenced
from tessera.operators.projection import drop_columns, fill_defaults, rename_all
from tessera.operators.sets import align_union
from tessera.plans import audit as j4
from tessera.plans import bulk_load as j9
from tessera.plans import dependency as j6
from tessera.plans import file_copies
from tessera.plans import load_op as j2
from tessera.plans import positional as j3
from tessera.plans import row_report as j10
from tessera.plans import scrub as j1
from tessera.plans import stale as j7
from tessera.plans import usage as j5
from tessera.session import scratch_path
from tessera.sinks.files import read_report, write_csv, write_dual, write_json_lines, write_report
from tessera.sources.files import path_columns, read_csv, with_file_path


# The test tables.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def q_scrub_customer(spark, sf_dir):
    return j1.scrub(j1.customer_input(table(spark, sf_dir, "customer")))


def q_scrub_documents(spark, sf_dir):
    return j1.scrub(j1.documents_input(table(spark, sf_dir, "documents")))


def q_scrub_customer_sql(spark, sf_dir):
    """J1 through the SQL surface: the column functions registered as SQL functions."""
    fsql.register(spark)
    j1.customer_input(table(spark, sf_dir, "customer")).createOrReplaceTempView("tessera_scrub_input")
    return spark.sql("SELECT 1 AS col0, col1, col2, hash_email(col3) AS col3, newlines_to_space(col4) AS col4, col5 "
                     "FROM tessera_scrub_input")


def q_stale_orders(spark, sf_dir):
    items = j7.orders_input(table(spark, sf_dir, "orders"))
    active = j7.open_line_orders(table(spark, sf_dir, "lineitem"))
    return j7.stale_items(items, active, days=100, as_of="2001-08-01")


def q_orders_without_lines(spark, sf_dir):
    """E3 alone: orders that no line item refers to."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return unreferenced(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", active_key="l_orderkey")


def q_usage_report(spark, sf_dir):
    return j5.usage_report(j5.events_table(table(spark, sf_dir, "events")), "user_id")


def q_usage_totals(spark, sf_dir):
    return j5.usage_totals(j5.events_table(table(spark, sf_dir, "events")))


def q_positional_merge(spark, sf_dir):
    return j3.positional_merge(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"),
                               "c_custkey", "s_suppkey")


def _supplier_report(spark, sf_dir):
    groups = j6.supplier_groups(table(spark, sf_dir, "supplier"))
    li = table(spark, sf_dir, "lineitem")
    edges = j6.group_edges([j6.edges_from(li, "l_partkey", "PART", "l_suppkey", as_string=False)])
    return j6.dependency_report(groups, edges)


def _nation_report(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    groups = j6.nation_groups(t["nation"])
    rules = j6.trade_rules(t["lineitem"], t["orders"], t["customer"], t["supplier"])
    edges = j6.group_edges([j6.edges_from(t["customer"], "c_custkey", "CUSTOMER", "c_nationkey"),
                            j6.edges_from(t["supplier"], "s_suppkey", "SUPPLIER", "s_nationkey")],
                           groups=groups, rules=rules)
    return j6.dependency_report(groups, edges)


def q_supplier_dependency(spark, sf_dir):
    return j6.report_lines(_supplier_report(spark, sf_dir))


def q_nation_dependency(spark, sf_dir):
    return j6.report_lines(_nation_report(spark, sf_dir))


def q_nation_dependency_json(spark, sf_dir):
    return j6.report_json(_nation_report(spark, sf_dir))


def q_bulk_load_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "landing")
    j9.write_changes(j9.orders_changes(orders), root, "tpch", "orders", ["o_orderkey"])
    results, _status = j9.bulk_load(spark, root, {("tpch", "orders"): (orders, ["o_orderkey"])})
    return results[("tpch", "orders")]


def q_row_report_customer(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return j10.row_lines(customer, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                         keep=["c_custkey"])


def q_audit_events(spark, sf_dir):
    path = scratch_path(spark, "audit")
    j4.events_folder(table(spark, sf_dir, "events"), path)
    a = j4.audit(spark, path, key="id", by="folder")
    return a.select(F.regexp_extract("folder", "event_type=([^/]*)$", 1).alias("event_type"),
                    "total_rows", "null_rows", "valid_rows", "is_total")


def q_audit_null_rows(spark, sf_dir):
    path = scratch_path(spark, "audit")
    j4.events_folder(table(spark, sf_dir, "events"), path)
    return j4.null_rows(spark, path, key="id").select("id", "ts", "user_id", "value", "props", "event_type")


def q_csv_roundtrip_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return j3.csv_round_trip(docs, scratch_path(spark, "roundtrip"), null_marker="NA")


def q_profile_orders(spark, sf_dir):
    return profile(table(spark, sf_dir, "orders"))


def q_load_op_orders(spark, sf_dir):
    """Two deliveries of load files at four depths (files, a folder, a compressed one), consumed and removed."""
    orders = table(spark, sf_dir, "orders")
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "load-out", "load-ckpt"))
    for first in (True, False):
        j2.orders_landing(orders, landing, first)
        j2.add_load_op(spark, landing, out, orders.columns, checkpoint=checkpoint, delete=True)
    return j2.read_output(spark, out).select("Op", *orders.columns, "database", "table")


def q_load_op_in_place_orders(spark, sf_dir):
    """The same load files, each with its output beside it; ``source`` is the output's folder."""
    orders = table(spark, sf_dir, "orders")
    landing = scratch_path(spark, "landing")
    for first in (True, False):
        j2.orders_landing(orders, landing, first)
    j2.add_load_op_in_place(spark, landing, orders.columns, checkpoint=scratch_path(spark, "load-ckpt"), single_file=True)
    rows = with_file_path(read_csv(spark, landing, recursive=True, glob="part-*").filter(F.col("_metadata.file_path").contains("/op-LOAD")))
    return rows.select("Op", *orders.columns, F.regexp_extract("file", "/op-(LOAD[0-9]+)[^/]*/[^/]*$", 1).alias("source"))


def q_load_and_changes_orders(spark, sf_dir):
    """Load rows with their operation stacked on a change file's, each with its place from the path."""
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "landing")
    write_csv(orders, f"{root}/tpch/orders/LOAD1")
    write_csv(j2.orders_changes(orders), f"{root}/tpch/orders/changes")
    load, changes = (with_file_path(read_csv(spark, f"{root}/tpch/orders/{n}")) for n in ("LOAD1", "changes"))
    placed = path_columns(align_union(load, changes), root, depth=4, names=("database", "table", "kind"))
    placed = placed.withColumn("suffix", F.regexp_extract(basename("file"), "([.][a-z]+)$", 1))
    return drop_columns(placed, "file", "key").select("Op", *orders.columns, "database", "table", "kind", "bad_path", "suffix")


def _load_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "landing")
    j9.landing_with_failures(orders, root)
    return j9.bulk_load(spark, root, {("tpch", "orders"): (orders, ["o_orderkey"])})[1]


def q_load_status_orders(spark, sf_dir):
    """Status of every file of a landing folder: good, bad values, too deep, table that is no target."""
    return _load_status(spark, sf_dir).select("database", "table", "status", "reason", "n_rows", "n_bad_values")


def q_load_status_counts(spark, sf_dir):
    return status_counts(_load_status(spark, sf_dir))


def q_supplier_dependency_parts(spark, sf_dir):
    """The supplier report in parts of 50 ids."""
    groups = j6.supplier_groups(table(spark, sf_dir, "supplier"))
    edges = j6.group_edges([j6.edges_from(table(spark, sf_dir, "lineitem"), "l_partkey", "PART", "l_suppkey", as_string=False)])
    return j6.dependency_report(groups, edges, chunk_size=50).select("Group ID", "part", "Used Resources")


def q_nation_dependency_nested(spark, sf_dir):
    """Edges and rules from nested columns, each in one scan; every group lists SG."""
    nation = table(spark, sf_dir, "nation")
    edges = j6.edges_at(j6.nested_customers(table(spark, sf_dir, "customer")), "InstanceId", "EC2", j6.CUSTOMER_PATHS)
    rules = j6.rules_from_nested(j6.nested_nations(nation))
    groups = j6.nation_groups(nation)
    report = j6.dependency_report(groups, j6.edge_list(j6.group_edges([edges], groups=groups, rules=rules)), always_kinds=["SG"])
    path = scratch_path(spark, "nested-report")
    write_json_lines(j6.report_json(report), "json", path)
    return spark.read.text(path).select(F.regexp_extract("value", '^[{]"([^"]*)"', 1).alias("Group ID"), F.col("value").alias("json"))


def q_dependency_scoped(spark, sf_dir):
    """A list of asked ids, some malformed or unknown, in one network."""
    meta = j6.hex_groups(table(spark, sf_dir, "supplier"))
    asked = table(spark, sf_dir, "part").select(
        F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("SG-")).otherwise(F.lit("sg-")), F.lower(F.hex((F.col("p_partkey") * 3).cast("long")))).alias("GroupId"))
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("sg-"), F.lower(F.hex("l_suppkey"))).alias("g"), "l_partkey")
    edges = j6.group_edges([j6.edges_from(line, "l_partkey", "PART", "g")])
    return j6.report_lines(j6.dependency_report(j6.requested_groups(asked, meta, scope="vpc-1"), edges))


def q_usage_report_file(spark, sf_dir):
    """The ranked report written over several files and read back in order."""
    path = scratch_path(spark, "report")
    write_report(q_usage_report(spark, sf_dir), path, files=4)
    back = read_report(spark, path)
    return back.select(F.col("Row").cast("long").alias("Row"), "Bucket", "StandardSize", "IASize", "RRSize", "Total", "line")


def q_scrub_write_read(spark, sf_dir):
    """J1 from a catalog table with mixed and nested columns to both layouts, read back."""
    name = f"scrub_input_{uuid.uuid4().hex[:12]}"
    shaped = j1.nested_input(table(spark, sf_dir, "customer"))
    shaped.select("col1", "col2", "col3", "col4", "col5").write.option("path", scratch_path(spark, name)).saveAsTable(name)
    # a file has no columns without a type; a view over the table adds them
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}_v AS SELECT *, array(named_struct('n', CAST(col5 AS INT), 'none', NULL)) AS col6, "
              f"map(col3, named_struct('n', CAST(col5 AS INT), 'none', NULL)) AS col7, array(NULL) AS col8 FROM {name}")
    parquet, csv = j1.run(spark, None, f"{name}_v", scratch_path(spark, "scrub"), "tpch", mapping=j1.NESTED_MAPPING, mixed={"col1": ["long", "string"]})
    spark.catalog.dropTempView(f"{name}_v")
    spark.sql(f"DROP TABLE {name}")
    nested = ("col1", "col6", "col7")
    rows = parquet.select(F.lit("parquet").alias("layout"), *[(F.to_json(c) if c in nested else F.col(c).cast("string")).alias(c) for c in parquet.columns])
    return rows.unionByName(csv.select(F.lit("csv").alias("layout"), *csv.columns))


def q_publish_customer(spark, sf_dir):
    """Scrubbed customers under their published names, read back."""
    base, target = scratch_path(spark, "results"), scratch_path(spark, "published")
    write_dual(q_scrub_customer(spark, sf_dir), base, "tpch", "customer")
    copied = file_copies.publish(spark, base, "tpch", target)
    n_files = copied.filter(F.col("target").endswith(".csv") & (F.col("bytes") > 0)).agg(F.count(F.lit(1)))
    rows = read_csv(spark, f"{target}/tpch/customer", glob="*.csv", multi_line=True)
    return rows.filter(n_files.scalar() > 0)


def q_hash_value_customer(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    hashed = customer.select("c_custkey", hash_value("c_name"), hash_value("c_custkey", salt="pepper"), "c_mktsegment")
    return rename_all(hashed, ["key", "name_hash", "key_hash", "segment"])


def q_sql_functions_part(spark, sf_dir):
    """The other SQL functions (I1) over ``part``."""
    fsql.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("tessera_part_input")
    return spark.sql("""SELECT p_partkey, hash_value(p_name) AS name_hash, human_size(p_partkey * p_partkey * p_size * 997) AS size, is_email(concat(replace(p_brand, '#', '.'), '@x.org')) AS mail,
                               map_sql_type(concat(element_at(array('int(10) unsigned', 'bigint(20)', 'datetime(6)', 'varchar(9)', 'decimal(10, 2)', 'float', 'double'),
                                                              CAST(p_partkey % 7 AS INT) + 1))) AS type
                        FROM tessera_part_input""")


def q_row_index_orders(spark, sf_dir):
    """E1 by a column with many equal values: each status' orders get one stretch of places."""
    indexed = add_row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "idx", order_by=["o_orderstatus"])
    return indexed.groupBy("o_orderstatus").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_distinct("idx").alias("places"))


def q_row_count_lineitem(spark, sf_dir):
    return row_count(table(spark, sf_dir, "lineitem"))


def q_customers_not_in_orders(spark, sf_dir):
    """Customers without a pending order, with defaults for what is missing."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    idle = not_in(customer, orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    rich = idle.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return fill_defaults(rich, {"segment": "none"})


def q_daily_average_events(spark, sf_dir):
    d = daily_average(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "value")
    return d.withColumn("average", F.round("average", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scrub_customer": q_scrub_customer,
    "scrub_documents": q_scrub_documents,
    "scrub_customer_sql": q_scrub_customer_sql,
    "stale_orders": q_stale_orders,
    "orders_without_lines": q_orders_without_lines,
    "usage_report": q_usage_report,
    "usage_totals": q_usage_totals,
    "positional_merge": q_positional_merge,
    "supplier_dependency": q_supplier_dependency,
    "nation_dependency": q_nation_dependency,
    "nation_dependency_json": q_nation_dependency_json,
    "bulk_load_orders": q_bulk_load_orders,
    "row_report_customer": q_row_report_customer,
    "audit_events": q_audit_events,
    "audit_null_rows": q_audit_null_rows,
    "csv_roundtrip_documents": q_csv_roundtrip_documents,
    "profile_orders": q_profile_orders,
    "load_op_orders": q_load_op_orders,
    "load_op_in_place_orders": q_load_op_in_place_orders,
    "load_and_changes_orders": q_load_and_changes_orders,
    "load_status_orders": q_load_status_orders,
    "load_status_counts": q_load_status_counts,
    "supplier_dependency_parts": q_supplier_dependency_parts,
    "nation_dependency_nested": q_nation_dependency_nested,
    "dependency_scoped": q_dependency_scoped,
    "usage_report_file": q_usage_report_file,
    "scrub_write_read": q_scrub_write_read,
    "publish_customer": q_publish_customer,
    "hash_value_customer": q_hash_value_customer,
    "sql_functions_part": q_sql_functions_part,
    "row_index_orders": q_row_index_orders,
    "row_count_lineitem": q_row_count_lineitem,
    "customers_not_in_orders": q_customers_not_in_orders,
    "daily_average_events": q_daily_average_events,
}


def human_size_sql(n: str) -> str:
    """The C12 rule in DuckDB: the number of thousands by the digits, half-up to one decimal."""
    k = f"least(5, (length(CAST({n} AS VARCHAR)) - 1) // 3)"
    tenths = f"(({n} * 10 + CAST(pow(1000, {k}) AS HUGEINT) // 2) // CAST(pow(1000, {k}) AS HUGEINT))"
    return (f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) || 'B' ELSE CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) "
            f"|| ['KB', 'MB', 'GB', 'TB', 'PB'][CAST({k} AS INT)] END")


def _dependency_sql(edges: str, groups: str) -> str:
    """Report text per group in SQL: distinct edges, sorted ids per kind, kinds in order."""
    return f"""
WITH e AS (SELECT DISTINCT * FROM ({edges})),
k AS (SELECT g, kind, list_sort(list(item)) AS ids FROM e GROUP BY g, kind),
r AS (SELECT g, string_agg('- ' || kind || ' : ' || array_to_string(ids, ', ') || chr(10), '' ORDER BY kind) AS txt,
             '{{' || string_agg(to_json(kind) || ':' || to_json(ids), ',' ORDER BY kind) AS js
      FROM k GROUP BY g),
grp AS ({groups})
SELECT gid AS "Group ID", gname AS "Group Name", vpc AS VPC,
       CASE WHEN coalesce(txt, '') <> '' THEN 'YES' ELSE 'NO' END AS Used, '' AS Comments,
       coalesce(txt, '') AS "Used Resources",
       '{{' || to_json(gid) || ':' || CASE WHEN js IS NULL THEN '{{' ELSE js || ',' END
         || '"Metadata":' || to_json({{'Name': gname, 'VPC': vpc}}) || '}}}}' AS json
FROM grp LEFT JOIN r ON r.g = grp.gid"""


_NATION_EDGES = """
  SELECT CAST(c_nationkey AS VARCHAR) AS g, 'CUSTOMER' AS kind, CAST(c_custkey AS VARCHAR) AS item FROM customer
  UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'SUPPLIER', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT CAST(s.s_nationkey AS VARCHAR), 'SG', CAST(c.c_nationkey AS VARCHAR)
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""
_NATION_GROUPS = ("SELECT CAST(n_nationkey AS VARCHAR) AS gid, n_name AS gname, CAST(n_regionkey AS VARCHAR) AS vpc "
                  "FROM nation")
_SUPPLIER_EDGES = ("SELECT CAST(l_suppkey AS VARCHAR) AS g, 'PART' AS kind, CAST(l_partkey AS VARCHAR) AS item "
                   "FROM lineitem")
_SUPPLIER_GROUPS = ("SELECT CAST(s_suppkey AS VARCHAR) AS gid, s_name AS gname, CAST(s_nationkey AS VARCHAR) AS vpc "
                    "FROM supplier")
_REPORT_COLS = '"Group ID", "Group Name", VPC, Used, Comments, "Used Resources"'


_ROW_FIELDS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_text_fields = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _ROW_FIELDS)
_html_fields = ", ".join(
    f"replace(replace(replace(coalesce(CAST({c} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for c in _ROW_FIELDS)


_USAGE_WIDE = """
WITH day AS (
  SELECT user_id,
         CASE event_type WHEN 'view' THEN 'ST' WHEN 'click' THEN 'IA' WHEN 'error' THEN 'RR' END AS cls,
         CAST(round(value * 100) AS BIGINT) * 10000 AS bytes
  FROM events
  WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-03 00:00:00'
    AND event_type IN ('view', 'click', 'error')),
avgs AS (SELECT user_id, cls, CAST(sum(bytes) // count(*) AS BIGINT) AS a FROM day GROUP BY user_id, cls),
ents AS (SELECT DISTINCT user_id FROM events),
wide AS (
  SELECT e.user_id,
         coalesce(max(CASE WHEN cls = 'ST' THEN a END), 0) AS st,
         coalesce(max(CASE WHEN cls = 'IA' THEN a END), 0) AS ia,
         coalesce(max(CASE WHEN cls = 'RR' THEN a END), 0) AS rr
  FROM ents e LEFT JOIN avgs v ON e.user_id = v.user_id
  GROUP BY e.user_id),
tot AS (SELECT *, st + ia + rr AS total FROM wide)
"""

_EMAIL_SQL = rf"'\A{EMAIL_PATTERN}\n?\z'"


def _hash_email_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, {_EMAIL_SQL}) "
            rf"THEN sha256(regexp_extract({c}, '\A([^\n]*)', 1)) || CASE WHEN suffix({c}, chr(10)) THEN chr(10) ELSE '' END "
            f"ELSE {c} END")


_ORDER_TEXT = """CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"""

_LOAD_STATUS = """
WITH st AS (
  SELECT 'tpch' AS database, 'orders' AS "table", 'Success' AS status, CAST(NULL AS VARCHAR) AS reason,
         (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_rows, 0 AS n_bad_values
  UNION ALL SELECT 'tpch', 'orders', 'Failed', 'bad values', count(*), count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'
  UNION ALL SELECT NULL, NULL, 'Failed', 'bad path', NULL, NULL
  UNION ALL SELECT 'tpch', 'nobody', 'Failed', 'unknown table', NULL, NULL)"""


ORACLE: dict[str, str] = {
    "scrub_customer": f"""
WITH s AS (
  SELECT c_name AS col1, c_custkey AS col2,
         CASE WHEN c_custkey % 7 = 0 THEN c_name
              ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS col3,
         c_mktsegment || chr(10) || c_name AS col4,
         CAST(c_nationkey AS BIGINT) AS col5
  FROM customer)
SELECT 1 AS col0, col1, col2, {_hash_email_sql('col3')} AS col3,
       replace(col4, chr(10), ' ') AS col4, col5
FROM s""",
    "scrub_documents": f"""
SELECT 1 AS col0, lang AS col1, doc_id AS col2, {_hash_email_sql('source')} AS col3,
       replace(text, chr(10), ' ') AS col4, n_chars AS col5
FROM documents""",
    "stale_orders": """
SELECT o_orderkey AS name, CAST(o_orderdate AS DATE) AS created
FROM orders
WHERE CAST(o_orderdate AS DATE) < DATE '2001-08-01' - 100
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')""",
    "usage_report": _USAGE_WIDE + f"""
SELECT row_number() OVER (ORDER BY total DESC, user_id ASC) AS "Row", user_id AS Bucket,
       {human_size_sql('st')} AS StandardSize, {human_size_sql('ia')} AS IASize,
       {human_size_sql('rr')} AS RRSize, {human_size_sql('total')} AS Total
FROM tot""",
    "usage_totals": _USAGE_WIDE + f"""
, sums AS (SELECT CAST(sum(st) AS BIGINT) AS st, CAST(sum(ia) AS BIGINT) AS ia, CAST(sum(rr) AS BIGINT) AS rr,
                  CAST(sum(total) AS BIGINT) AS total FROM tot)
SELECT {human_size_sql('st')} AS StandardTotal, {human_size_sql('ia')} AS IATotal,
       {human_size_sql('rr')} AS RRTotal, {human_size_sql('total')} AS GrandTotal
FROM sums""",
    "positional_merge": """
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
     s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)
SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
       s.s_suppkey, s.s_name, s.s_nationkey, s.s_acctbal
FROM c JOIN s ON c.rn = s.rn""",
    "supplier_dependency": f"SELECT {_REPORT_COLS} FROM ({_dependency_sql(_SUPPLIER_EDGES, _SUPPLIER_GROUPS)})",
    "nation_dependency": f"SELECT {_REPORT_COLS} FROM ({_dependency_sql(_NATION_EDGES, _NATION_GROUPS)})",
    "nation_dependency_json": f'SELECT "Group ID", json FROM ({_dependency_sql(_NATION_EDGES, _NATION_GROUPS)})',
    "daily_average_events": """
SELECT user_id, event_type, date_trunc('day', ts) AS window_start, round(avg(value), 6) AS average
FROM events GROUP BY user_id, event_type, date_trunc('day', ts)""",
    "load_op_orders": f"""
SELECT 'I' AS Op, {_ORDER_TEXT},
       CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0) THEN 'tpch' END AS database,
       CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0) THEN 'orders' END AS "table"
FROM orders""",
    "load_op_in_place_orders": f"""
SELECT 'I' AS Op, {_ORDER_TEXT},
       CASE o_orderstatus WHEN 'F' THEN 'LOAD00000001' WHEN 'P' THEN 'LOAD2' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'LOAD3' ELSE 'LOAD4' END END AS source
FROM orders""",
    "load_and_changes_orders": f"""
SELECT 'I' AS Op, {_ORDER_TEXT}, 'tpch' AS database, 'orders' AS "table", 'LOAD1' AS kind, false AS bad_path, '.csv' AS suffix FROM orders
UNION ALL SELECT 'U', {_ORDER_TEXT}, 'tpch', 'orders', 'changes', false, '.csv' FROM orders WHERE o_orderstatus = 'F'""",
    "load_status_orders": f"{_LOAD_STATUS} SELECT * FROM st",
    "load_status_counts": f"{_LOAD_STATUS} SELECT status, count(*) AS n_files FROM st GROUP BY status",
    "supplier_dependency_parts": """
WITH e AS (SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS item FROM lineitem),
n AS (SELECT l_suppkey, item, CAST((row_number() OVER (PARTITION BY l_suppkey ORDER BY item) - 1) // 50 AS BIGINT) AS part FROM e),
p AS (SELECT l_suppkey, part, '- PART : ' || string_agg(item, ', ' ORDER BY item) || chr(10) AS txt FROM n GROUP BY l_suppkey, part)
SELECT CAST(s_suppkey AS VARCHAR) AS "Group ID", coalesce(part, 0) AS part, coalesce(txt, '') AS "Used Resources"
FROM supplier LEFT JOIN p ON l_suppkey = s_suppkey""",
    "nation_dependency_nested": """
WITH named AS (
  SELECT c_custkey, c_nationkey AS g FROM customer WHERE c_custkey % 2 = 0
  UNION SELECT c_custkey, unnest([c_nationkey, (c_nationkey + 1) % 25]) FROM customer WHERE c_custkey % 5 > 0
  UNION SELECT c_custkey, (c_nationkey + 5) % 25 FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 4 = 0
  UNION SELECT c_custkey, (c_nationkey + 2) % 25 FROM customer WHERE c_custkey % 3 = 0),
refs AS (
  SELECT o.n_nationkey AS owner, i.n_nationkey AS g FROM nation o JOIN nation i ON i.n_nationkey % 2 = 0 AND o.n_regionkey = (i.n_regionkey + 1) % 5
  UNION SELECT o.n_nationkey, i.n_nationkey FROM nation o JOIN nation i ON o.n_regionkey = i.n_regionkey WHERE o.n_nationkey % 3 > 0),
e AS (SELECT g, list(CAST(c_custkey AS VARCHAR) ORDER BY CAST(c_custkey AS VARCHAR)) AS ids FROM named GROUP BY g),
r AS (SELECT g, list(CAST(owner AS VARCHAR) ORDER BY CAST(owner AS VARCHAR)) AS ids FROM refs GROUP BY g)
SELECT CAST(n_nationkey AS VARCHAR) AS "Group ID",
       '{' || to_json(CAST(n_nationkey AS VARCHAR)) || ':{' || CASE WHEN e.ids IS NULL THEN '' ELSE '"EC2":' || to_json(e.ids) || ',' END
       || '"SG":' || to_json(coalesce(r.ids, [])) || ',"Metadata":' || to_json({'Name': n_name, 'VPC': CAST(n_regionkey AS VARCHAR)}) || '}}' AS json
FROM nation LEFT JOIN e ON e.g = n_nationkey LEFT JOIN r ON r.g = n_nationkey""",
    "dependency_scoped": """
WITH asked AS (SELECT DISTINCT p_partkey * 3 AS k FROM part WHERE p_partkey % 4 <> 0),
e AS (SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS item FROM lineitem),
t AS (SELECT l_suppkey, '- PART : ' || string_agg(item, ', ' ORDER BY item) || chr(10) AS txt FROM e GROUP BY l_suppkey)
SELECT 'sg-' || lower(hex(s_suppkey)) AS "Group ID", s_name AS "Group Name", 'vpc-1' AS VPC, CASE WHEN txt IS NULL THEN 'NO' ELSE 'YES' END AS Used, '' AS Comments,
       coalesce(txt, '') AS "Used Resources"
FROM asked JOIN supplier ON s_suppkey = k LEFT JOIN t ON l_suppkey = s_suppkey WHERE s_nationkey % 5 = 1""",
    "usage_report_file": _USAGE_WIDE + f"""
SELECT row_number() OVER (ORDER BY total DESC, user_id ASC) AS "Row", CAST(user_id AS VARCHAR) AS Bucket,
       {human_size_sql('st')} AS StandardSize, {human_size_sql('ia')} AS IASize, {human_size_sql('rr')} AS RRSize, {human_size_sql('total')} AS Total,
       row_number() OVER (ORDER BY total DESC, user_id ASC) AS line
FROM tot""",
    "scrub_write_read": f"""
WITH s AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN '{{"long":' || c_custkey || '}}' ELSE to_json({{'string': c_name}}) END AS col1, CAST(c_custkey AS VARCHAR) AS col2,
         CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS mail,
         c_mktsegment || ' ' || c_name AS col4, CAST(c_nationkey AS VARCHAR) AS col5
  FROM customer)
SELECT layout, '1' AS col0, col1, col2, {_hash_email_sql('mail')} AS col3, col4, col5,
       '[{{"n":' || col5 || '}}]' AS col6, '{{' || to_json(mail) || ':{{"n":' || col5 || '}}}}' AS col7
FROM s, (VALUES ('parquet'), ('csv')) AS v(layout)""",
    "publish_customer": f"""
SELECT '1' AS col0, c_name AS col1, CAST(c_custkey AS VARCHAR) AS col2,
       {_hash_email_sql("CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE lower(replace(c_name, '#', '.')) || '@example.com' END")} AS col3,
       c_mktsegment || ' ' || c_name AS col4, CAST(c_nationkey AS VARCHAR) AS col5
FROM customer""",
    "hash_value_customer": """
SELECT c_custkey AS key, sha256(c_name) AS name_hash, sha256('pepper' || c_custkey) AS key_hash, c_mktsegment AS segment FROM customer""",
    "sql_functions_part": f"""
SELECT p_partkey, sha256(p_name) AS name_hash, {human_size_sql('(p_partkey * p_partkey * p_size * 997)')} AS size, true AS mail,
       ['long', 'long', 'timestamp', 'string', 'decimal(10,2)', 'string', 'float'][CAST(p_partkey % 7 AS INT) + 1] AS type
FROM part""",
    "row_index_orders": """
WITH r AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS idx FROM orders)
SELECT o_orderstatus, min(idx) AS "first", max(idx) AS "last", count(DISTINCT idx) AS places FROM r GROUP BY o_orderstatus""",
    "row_count_lineitem": "SELECT count(*) AS n_rows FROM lineitem",
    "customers_not_in_orders": """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'none' END AS segment
FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "row_report_customer": f"""
SELECT c_custkey,
       concat_ws(',', {_text_fields}) AS text_line,
       '<tr><td>' || concat_ws('</td><td>', {_html_fields}) || '</td></tr>' AS html_line
FROM customer""",
    "audit_events": """
SELECT event_type, count(*) AS total_rows, count(*) FILTER (WHERE value < 1) AS null_rows,
       count(*) FILTER (WHERE value >= 1) AS valid_rows, grouping(event_type) = 1 AS is_total
FROM events GROUP BY ROLLUP (event_type)""",
    "audit_null_rows": """
SELECT CAST(NULL AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(user_id AS VARCHAR) AS user_id,
       CAST(value AS VARCHAR) AS value, props, event_type
FROM events WHERE value < 1""",
    "csv_roundtrip_documents": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "profile_orders": """
WITH n AS (SELECT count(*) AS rows, count(o_orderkey) AS c1, count(o_custkey) AS c2, count(o_orderstatus) AS c3,
                  count(o_totalprice) AS c4, count(o_orderdate) AS c5, count(o_orderpriority) AS c6 FROM orders)
SELECT 1 AS position, 'o_orderkey' AS "column", 'bigint' AS type, c1 AS non_null, rows - c1 AS nulls, rows FROM n
UNION ALL SELECT 2, 'o_custkey', 'bigint', c2, rows - c2, rows FROM n
UNION ALL SELECT 3, 'o_orderstatus', 'string', c3, rows - c3, rows FROM n
UNION ALL SELECT 4, 'o_totalprice', 'double', c4, rows - c4, rows FROM n
UNION ALL SELECT 5, 'o_orderdate', 'timestamp_ntz', c5, rows - c5, rows FROM n
UNION ALL SELECT 6, 'o_orderpriority', 'string', c6, rows - c6, rows FROM n""",
    "bulk_load_orders": """
WITH inc AS (
  SELECT o_orderkey, o_custkey, 'P' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 AS seq
  FROM orders WHERE o_orderstatus = 'O'
  UNION ALL
  SELECT o_orderkey, o_custkey, 'F', o_totalprice + 1.0, o_orderdate, o_orderpriority, 2
  FROM orders WHERE o_orderstatus = 'O'
  UNION ALL
  SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders), o_custkey, 'O', o_totalprice, o_orderdate,
         o_orderpriority, 1
  FROM orders WHERE o_orderstatus = 'P'),
last AS (SELECT * EXCLUDE (seq) FROM inc QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last)
UNION ALL SELECT * FROM last""",
}

ORACLE["scrub_customer_sql"] = ORACLE["scrub_customer"]
ORACLE["orders_without_lines"] = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
