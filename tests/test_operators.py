import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import (add_constant, add_row_index, apply_mapping, audit_files, drop_null_fields, edges_at,
                               edges_from, group_ids, ids_of, make_struct, nested_ids,
                               positional_join, profile, referencing_groups, rename_all, restrict_to,
                               rules_from_nested, union_edges, unreferenced, upsert)
from tessera.plans import dependency as j6
from tessera.plans.stale import stale_items

DATA = "/root/testdata/sf0.01"


def test_row_index_sorted_is_dense(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet").repartition(7)
    out = add_row_index(li, "idx", order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    agg = out.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.count("*")).first()
    assert tuple(agg) == (0, 59999, 60000, 60000)
    assert out.schema["idx"].dataType == T.LongType() and not out.schema["idx"].nullable
    # equals the sorted position
    first = out.orderBy("idx").limit(5).select("l_orderkey").collect()
    expect = li.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(5).select("l_orderkey").collect()
    assert first == expect


def test_row_index_file_order(spark):
    c = spark.read.parquet(f"{DATA}/customer.parquet")
    out = add_row_index(c, "idx", checkpoint=False)
    rows = out.select("c_custkey", "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(c.count()))


def _indent(line):
    return len(line) - len(line.lstrip(" :|+-"))


def single_partition_outside_broadcast(plan: str) -> list:
    """Lines of ``Exchange SinglePartition`` that do not sit below a ``BroadcastExchange``."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        level, inside = _indent(line), False
        for up in reversed(lines[:i]):
            if _indent(up) < level:
                level = _indent(up)
                if "BroadcastExchange" in up:
                    inside = True
                    break
        if not inside:
            bad.append(line)
    return bad


def test_row_index_plan_has_no_single_partition_row_path(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    for df in (add_row_index(li, "idx", checkpoint=False), add_row_index(li, "idx", order_by=["l_orderkey"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" in plan  # the offsets window over one row per partition ...
        assert single_partition_outside_broadcast(plan) == []  # ... only on the broadcast side
    # the checker does see an unpartitioned row_number (the plan this operator avoids)
    from pyspark.sql import Window
    naive = li.withColumn("rn", F.row_number().over(Window.orderBy("l_orderkey")))
    assert single_partition_outside_broadcast(naive._jdf.queryExecution().executedPlan().toString())


def test_positional_join_cuts_longer_side(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "k long, a string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3)], "j int, b string")
    out = positional_join(a, b, "k", "j").orderBy("k").collect()
    assert [tuple(r) for r in out] == [(0, "a0", 0, "b0"), (1, "a1", 1, "b1"), (2, "a2", 2, "b2")]


def test_positional_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("x", 1.5), ("x", 1.5), ("y", 2.0)], "name string, price double")
    right = spark.createDataFrame([(True,), (True,)], "flag boolean")
    out = positional_join(left, right)
    assert out.columns == ["name", "price", "flag"]
    assert out.count() == 2


def test_unreferenced_null_in_active(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    active = spark.createDataFrame([("a",), (None,)], "name string")
    assert sorted(r[0] for r in unreferenced(items, active, "name").collect()) == ["b", "c"]


def test_older_than_strict(spark):
    as_of = dt.date(2024, 4, 10)
    rows = [("x", as_of - dt.timedelta(days=100)), ("y", as_of - dt.timedelta(days=101)), ("z", as_of)]
    items = spark.createDataFrame(rows, "name string, created date")
    active = spark.createDataFrame([("zz",)], "name string")
    got = [r[0] for r in stale_items(items, active, days=100, as_of=as_of).collect()]
    assert got == ["y"]
    with pytest.raises(ValueError):
        stale_items(items, active, days=100)


def test_upsert_last_duplicate_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    inc = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (4, "d", 1), (4, "d0", 0)], "k int, v string, seq int")
    out = sorted(tuple(r) for r in upsert(base, inc, ["k"], order_by=["seq"]).collect())
    assert out == [(1, "a"), (2, "b2"), (3, "c"), (4, "d")]


def test_apply_mapping_try_cast_and_prune(spark):
    df = spark.createDataFrame([("1", "x", "9"), ("oops", "y", "7")], "a string, b string, c string")
    out = apply_mapping(df, [("a", "string", "id", "long"), ("b", "string", "name", "string")])
    assert out.columns == ["id", "name"]
    assert [tuple(r) for r in out.collect()] == [(1, "x"), (None, "y")]


def test_constant_first_and_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = add_constant(df, "col0", 1)
    assert out.columns == ["col0", "a", "b"]
    assert rename_all(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        rename_all(df, ["x"])


def test_drop_null_fields(spark):
    df = spark.sql("select 1 as a, null as b, named_struct('x', 1, 'y', null) as s, cast(null as int) as c")
    out = drop_null_fields(df)
    assert out.columns == ["a", "s", "c"]
    assert out.schema["s"].dataType.fieldNames() == ["x"]
    assert drop_null_fields(df, data=True).columns == ["a", "s"]


def test_make_struct(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "v string")
    out = [tuple(r[0]) if r[0] else None for r in make_struct(df, "v").collect()]
    assert out == [(12, None), (None, "x"), (None, None)]


def test_audit_valid_plus_null_is_total(spark):
    df = spark.createDataFrame([("f1", 1), ("f1", None), ("f2", None), ("f2", 3), ("f2", 4)], "file string, id int")
    rows = {r.file: r for r in audit_files(df, "id").collect()}
    assert rows["f1"].total_rows == 2 and rows["f1"].null_rows == 1
    total = [r for r in rows.values() if r.is_total][0]
    assert (total.total_rows, total.null_rows, total.valid_rows) == (5, 2, 3)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = [tuple(r) for r in profile(df).orderBy("position").collect()]
    assert got == [(1, "a", "int", 2, 0, 2), (2, "b", "string", 1, 1, 2)]


def test_nested_edge_shapes(spark):
    inst_schema = ("InstanceId string, SecurityGroups array<struct<GroupId:string>>, "
                   "NetworkInterfaces array<struct<Groups:array<struct<GroupId:string>>>>")
    inst = spark.createDataFrame([
        ("i-1", [("sg-a",), ("sg-b",)], [([("sg-a",), ("sg-c",)],)]),
        ("i-2", None, None),
    ], inst_schema)
    lb = spark.createDataFrame([("lb-1", ["sg-b"]), ("lb-2", None)], "Name string, SecurityGroups array<string>")
    emr = spark.createDataFrame([("j-1", "sg-a", "sg-c", ["sg-d"], None)],
                                "Id string, Master string, Slave string, AddMaster array<string>, Service string")
    edges = union_edges([
        edges_from(inst, "InstanceId", "EC2", ids_of("SecurityGroups", "GroupId")),
        edges_from(inst, "InstanceId", "EC2", nested_ids("NetworkInterfaces", "Groups", "GroupId")),
        edges_from(lb, "Name", "ELB", "SecurityGroups"),
        edges_from(emr, "Id", "EMR", "Master"), edges_from(emr, "Id", "EMR", "Slave"),
        edges_from(emr, "Id", "EMR", "AddMaster"), edges_from(emr, "Id", "EMR", "Service"),
    ])
    m = {r.group_id: r.resources for r in group_ids(edges, "group_id", "kind", "item_id").collect()}
    assert m["sg-a"] == {"EC2": ["i-1"], "EMR": ["j-1"]}
    assert m["sg-b"] == {"EC2": ["i-1"], "ELB": ["lb-1"]}
    assert m["sg-c"] == {"EC2": ["i-1"], "EMR": ["j-1"]}
    assert m["sg-d"] == {"EMR": ["j-1"]}


def test_referencing_groups_and_report(spark):
    groups = spark.createDataFrame([("sg-a", "web", "vpc-1"), ("sg-b", "db", "vpc-1"), ("sg-z", "x", "vpc-2")],
                                   "GroupId string, GroupName string, VPC string")
    nested = spark.createDataFrame([
        ("sg-a", [([("sg-b",)],)], None),
        ("sg-b", [([("sg-b",), ("sg-a",)],)], [([("sg-a",)],)]),
        ("sg-q", None, [([("sg-b",)],)]),
    ], "GroupId string, IpPermissions array<struct<UserIdGroupPairs:array<struct<GroupId:string>>>>, "
       "IpPermissionsEgress array<struct<UserIdGroupPairs:array<struct<GroupId:string>>>>")
    rules = rules_from_nested(nested)
    refs = sorted(tuple(r) for r in referencing_groups(groups, rules).collect())
    assert refs == [("sg-a", "sg-b"), ("sg-b", "sg-a"), ("sg-b", "sg-b"), ("sg-b", "sg-q")]
    edges = j6.group_edges([], groups=groups, rules=rules)
    rep = {r["Group ID"]: r for r in j6.dependency_report(groups, edges, scope="vpc-1").collect()}
    assert set(rep) == {"sg-a", "sg-b"}
    assert rep["sg-b"]["Used Resources"] == "- SG : sg-a, sg-b, sg-q\n"
    legacy = j6.dependency_report(groups, edges, legacy_used=True)
    assert {r["Used"] for r in legacy.collect()} == {"YES"}
    empty = {r["Group ID"]: r["Used"] for r in j6.dependency_report(groups, edges).collect()}
    assert empty["sg-z"] == "NO"
    js = {r["Group ID"]: r["json"] for r in j6.report_json(j6.dependency_report(groups, edges)).collect()}
    assert js["sg-z"] == '{"sg-z":{"Metadata":{"Name":"x","VPC":"vpc-2"}}}'
    assert js["sg-a"] == '{"sg-a":{"SG":["sg-b"],"Metadata":{"Name":"web","VPC":"vpc-1"}}}'


def test_restrict_to_keeps_unknown(spark):
    ids = spark.createDataFrame([("a",), ("q",)], "k string")
    facts = spark.createDataFrame([("a", 1)], "k string, n int")
    out = {r.k: r.n for r in restrict_to(ids, facts, "k", empty={"n": F.lit(0)}).collect()}
    assert out == {"a": 1, "q": 0}


def test_group_ids_splits_a_hot_group_into_bounded_parts(spark):
    hot = spark.range(0, 5000).select(F.lit("g-hot").alias("g"), F.lit("EC2").alias("t"), F.col("id").cast("string").alias("i"))
    cold = spark.createDataFrame([("g-cold", "EC2", "x"), ("g-cold", "ELB", "y"), ("g-cold", "EC2", "x")], "g string, t string, i string")
    out = group_ids(hot.unionByName(cold).unionByName(hot), "g", "t", "i", chunk_size=500)
    rows = out.collect()
    cold_rows = [r for r in rows if r.g == "g-cold"]
    assert len(cold_rows) == 1 and cold_rows[0].resources == {"EC2": ["x"], "ELB": ["y"]} and cold_rows[0].part == 0
    hot_rows = [r for r in rows if r.g == "g-hot"]
    assert len(hot_rows) == 10
    ids = [x for r in hot_rows for x in r.resources["EC2"]]
    assert sorted(ids) == sorted(str(i) for i in range(5000))  # every id once, none dropped
    assert all(r.resources["EC2"] == sorted(r.resources["EC2"]) for r in hot_rows)
    assert max(len(r.resources["EC2"]) for r in hot_rows) < 2 * 500


def test_group_ids_parts_are_stretches_of_the_sorted_ids(spark):
    hot = spark.range(0, 3000).select(F.lit("g-hot").alias("g"), F.lit("EC2").alias("t"), F.col("id").cast("string").alias("i"))
    warm = spark.range(0, 700).select(F.lit("g-hot").alias("g"), F.lit("ELB").alias("t"), F.col("id").cast("string").alias("i"))
    cold = spark.createDataFrame([("g-cold", "EC2", "x"), ("g-none", None, "y")], "g string, t string, i string")
    edges = hot.unionByName(warm).unionByName(cold)
    for chunk in (500, 499, 1, 100_000):
        rows = group_ids(edges, "g", "t", "i", chunk_size=chunk).filter("g <> 'g-none'").collect()
        parts = {(r.g, r.part): r.resources for r in rows}
        for kind, n in (("EC2", 3000), ("ELB", 700)):
            ids = sorted(str(i) for i in range(n))
            for k in range(-(-n // chunk)):
                assert parts["g-hot", k][kind] == ids[k * chunk:(k + 1) * chunk]
        assert len(rows) == len(parts) == -(-3000 // chunk) + 1
        assert parts["g-cold", 0] == {"EC2": ["x"]}
    whole = group_ids(edges.filter("t is not null"), "g", "t", "i", chunk_size=None).collect()
    assert {r.g: r.part for r in whole} == {"g-hot": 0, "g-cold": 0}
    with_copies = group_ids(cold.unionByName(cold).filter("t is not null"), "g", "t", "i", keep_duplicates=True).first()
    assert with_copies.resources == {"EC2": ["x", "x"]}


def test_nested_paths(spark):
    rows = spark.createDataFrame([
        ("i-1", [("sg-a",), (None,)], [([("sg-b",), ("sg-a",)],), (None,)], "sg-c", ["sg-d", None]),
        ("i-2", None, None, None, None), ("i-3", [], [([],)], "sg-a", []), (None, [("sg-a",)], None, None, None)],
        "id string, own array<struct<GroupId:string>>, nets array<struct<Groups:array<struct<GroupId:string>>>>, main string, more array<string>")
    got = edges_at(rows, "id", "EC2", ["own[].GroupId", "nets[].Groups[].GroupId", "main", "more[]", "absent[].GroupId"])
    assert sorted(tuple(r) for r in got.collect()) == [("sg-a", "EC2", "i-1"), ("sg-a", "EC2", "i-3"), ("sg-b", "EC2", "i-1"), ("sg-c", "EC2", "i-1"), ("sg-d", "EC2", "i-1")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan


def test_requested_groups_and_single_report(spark):
    meta = spark.createDataFrame([("sg-1", "a", "vpc-1"), ("sg-2", "b", "vpc-2")], "GroupId string, GroupName string, VPC string")
    asked = spark.createDataFrame([("sg-1",), ("sg-1",), ("SG-2",), ("sg-2x",), ("sg-2",), ("sg-9",), (None,)], "GroupId string")
    assert sorted((r.GroupId, r.VPC) for r in j6.requested_groups(asked, meta).collect()) == [("sg-1", "vpc-1"), ("sg-2", "vpc-2"), ("sg-9", None)]
    assert [r.GroupId for r in j6.requested_groups(asked, meta, scope="vpc-2").collect()] == ["sg-2"]
    edges = spark.createDataFrame([("sg-1", "EC2", "i")], "group_id string, kind string, item_id string")
    one = j6.group_report("sg-1", meta, edges, always_kinds=["SG"]).collect()
    assert [(r["Group ID"], r.resources) for r in one] == [("sg-1", {"EC2": ["i"], "SG": []})]
    for bad in ("sg-", "sg-G", "x"):
        with pytest.raises(ValueError):
            j6.group_report(bad, meta, edges)
    with pytest.raises(ValueError):
        j6.requested_groups(asked, meta, scope="vpc-1; x")


def test_drop_null_fields_inside_arrays_and_maps(spark):
    df = spark.sql("""SELECT 1 AS a, array(named_struct('x', 1, 'n', NULL), NULL) AS s, map('k', named_struct('n', NULL, 'y', array(named_struct('n', NULL, 'z', 2)))) AS m,
                      array(NULL) AS v, map('k', NULL) AS w, array(array(NULL)) AS u, named_struct('n', NULL) AS o, map(named_struct('i', 1, 'n', NULL), 'q') AS k,
                      CAST(NULL AS array<struct<x:int,n:void>>) AS z""")
    out = drop_null_fields(df)
    assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == {
        "a": "int", "s": "array<struct<x:int>>", "m": "map<string,struct<y:array<struct<z:int>>>>", "k": "map<struct<i:int>,string>", "z": "array<struct<x:int>>"}
    row = out.first()
    assert row.s[0].x == 1 and row.s[1] is None and row.m["k"].y[0].z == 2 and row.z is None
    assert [(k.i, v) for k, v in row.k.items()] == [(1, "q")]


def test_audit_total_comes_from_the_files_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, None)], "file string, id int")
    out = audit_files(df, "id")
    assert sorted((r.file or "", r.total_rows, r.null_rows, r.valid_rows, r.is_total) for r in out.collect()) == [
        ("", 1, 1, 0, False), ("", 4, 2, 2, True), ("a", 2, 1, 1, False), ("b", 1, 0, 1, False)]
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_positional_join_cuts_the_longer_side_before_the_exchange(spark):
    left = spark.range(0, 1000).select(F.col("id").alias("a"))
    right = spark.range(0, 10).select((F.col("id") * 2).alias("b"))
    out = positional_join(left, right, "a", "b")
    assert sorted(tuple(r) for r in out.collect()) == [(i, 2 * i) for i in range(10)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the cut lies below the join of the two sides
    join = plan.index("Join Inner, (idx")
    assert plan.index("__tessera_len", join) > join
    assert positional_join(left.limit(0), right, "a", "b").count() == 0


def test_row_index_spreads_equal_keys(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = add_row_index(df, "idx", order_by="k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.idx for r in out.collect()) == list(range(5000))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    again = {r.id: r.idx for r in add_row_index(df, "idx", order_by="k").collect()}
    assert again == {r.id: r.idx for r in out.collect()}


def test_apply_mapping_missing_source_is_null(spark):
    df = spark.createDataFrame([("1",)], "a string")
    out = apply_mapping(df, [("a", "string", "a", "long"), ("zz", "string", "b", "string")])
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, None)
    assert out.schema["b"].dataType.simpleString() == "string"


def test_mapping_resolves_names_like_the_session(spark):
    from tessera.operators import apply_mapping

    out = apply_mapping(spark.createDataFrame([("5",)], "id string"), [("ID", "string", "key", "long"), ("none", "long", "gone", "long")])
    assert [tuple(r) for r in out.collect()] == [(5, None)]


def test_make_struct_puts_a_value_into_one_field(spark):
    out = make_struct(spark.createDataFrame([("12",), ("1.5",), ("x",)], "v string"), "v", ["long", "double", "string"])
    assert [tuple(r.v) for r in out.collect()] == [(12, None, None), (None, 1.5, None), (None, None, "x")]
