"""J6 dependency_report: which resources use each group, as a reverse adjacency per group.

Edges ``(group_id, kind, item_id)`` come from any number of resource tables (H1), are made
distinct (H2), gathered per group as ``kind -> sorted ids`` (F8), restricted to the requested
groups with their metadata (D3, E4, E6) and rendered as report text (C17) and JSON (B8).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.render import resources_text
from tessera.functions.text import GROUP_ID_PATTERN, VPC_ID_PATTERN
from tessera.operators.aggregates import group_ids
from tessera.operators.filters import in_scope, matching
from tessera.operators.joins import attach_metadata, referencing_groups, restrict_to, rules_from_nested  # noqa: F401
from tessera.operators.sets import distinct_edges, edges_at, edges_from, union_edges

REPORT_COLUMNS = ["Group ID", "Group Name", "VPC", "Used", "Comments", "Used Resources"]


def group_edges(edge_parts: Iterable[DataFrame], groups: DataFrame | None = None, rules: DataFrame | None = None,
                ref_kind: str = "SG") -> DataFrame:
    """All edges; with ``groups`` + ``rules`` the groups that name a group in their rules (E5) are
    added as edges of kind ``ref_kind``."""
    parts = list(edge_parts)
    if groups is not None and rules is not None:
        refs = referencing_groups(groups, rules)
        parts.append(edges_from(refs, "ReferencingGroupId", ref_kind, "GroupId"))
    return union_edges(parts)


def edge_list(edges: DataFrame) -> DataFrame:
    """H2: every edge once."""
    return distinct_edges(edges, ["group_id", "kind", "item_id"])


def dependency_map(edges: DataFrame, keep_duplicates: bool = False, chunk_size: int | None = 1_000_000) -> DataFrame:
    """F8: ``(group_id, part, resources map<kind, array<id>>)``."""
    return group_ids(edges, "group_id", "kind", "item_id", keep_duplicates=keep_duplicates, chunk_size=chunk_size)


def requested_groups(ids: DataFrame, meta: DataFrame, scope: str | None = None) -> DataFrame:
    """The groups of a list of ids (column ``GroupId``): ids of the right form only (D2), each once, with name and VPC (E6; null
    for an unknown group), in one VPC if ``scope`` names it (D3)."""
    if scope is not None and not re.fullmatch(VPC_ID_PATTERN, scope):
        raise ValueError(f"not a VPC id: {scope}")
    asked = matching(ids.select("GroupId"), "GroupId", GROUP_ID_PATTERN).distinct()
    return in_scope(attach_metadata(asked, meta.select("GroupId", "GroupName", "VPC"), "GroupId"), "VPC", scope)


def group_report(group_id: str, groups: DataFrame, edges: DataFrame, **report_args) -> DataFrame:
    """The report of one group; its id is checked first."""
    if not re.fullmatch(GROUP_ID_PATTERN, group_id):
        raise ValueError(f"not a group id: {group_id}")
    return dependency_report(groups.filter(F.col("GroupId") == group_id), edges, **report_args)


def dependency_report(groups: DataFrame, edges: DataFrame, scope=None, legacy_used: bool = False,
                      keep_duplicates: bool = False, chunk_size: int | None = 1_000_000, always_kinds: Sequence[str] = ()) -> DataFrame:
    """One row per requested group (``groups``: GroupId, GroupName, VPC; ``scope`` picks one VPC).

    Groups without any user are kept with an empty map; ``Used`` is ``NO`` for them unless
    ``legacy_used`` (then always ``YES``, as the source report printed). A group with more than
    ``chunk_size`` ids of one kind spans several rows (same ``Group ID``), ``part`` 0 with the first ids of
    each kind and so on. Kinds in ``always_kinds`` are in every group's map, with no ids where there are none
    (the source's JSON lists ``SG`` for every group in scope).
    """
    seeds = in_scope(groups, "VPC", scope).select(F.col("GroupId").cast("string").alias("group_id"),
                                                  "GroupName", "VPC")
    facts = dependency_map(edges, keep_duplicates, chunk_size)
    empty = F.create_map().cast("map<string,array<string>>")
    rep = restrict_to(seeds, facts, "group_id", empty={"resources": empty, "part": F.lit(0).cast("long")})
    if always_kinds:
        blank = F.map_from_arrays(F.array(*map(F.lit, always_kinds)), F.array(*[F.array().cast("array<string>") for _ in always_kinds]))
        missing = F.map_filter(blank, lambda k, v: ~F.array_contains(F.map_keys("resources"), k))
        rep = rep.withColumn("resources", F.when(F.col("part") == 0, F.map_concat("resources", missing)).otherwise(F.col("resources")))
    text = resources_text("resources")
    used = F.lit("YES") if legacy_used else F.when(text != "", F.lit("YES")).otherwise(F.lit("NO"))
    return rep.select(F.col("group_id").alias("Group ID"), F.col("GroupName").alias("Group Name"),
                      F.col("VPC").cast("string").alias("VPC"), used.alias("Used"), F.lit("").alias("Comments"),
                      text.alias("Used Resources"), "resources", "part")


def report_lines(report: DataFrame) -> DataFrame:
    """The report without the map column (CSV-ready)."""
    return report.select(*[F.col(f"`{c}`") for c in REPORT_COLUMNS])


def report_json(report: DataFrame, name: str = "json") -> DataFrame:
    """One JSON line per group, ``{"<group>": {"<kind>": [ids...], ..., "Metadata": {"Name": .., "VPC": ..}}}``.

    Kinds are in sorted order (``to_json`` of a sorted map), so the text is repeatable.
    """
    res = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("resources"))))
    meta = F.to_json(F.struct(F.col("`Group Name`").alias("Name"), F.col("VPC").alias("VPC")), {"ignoreNullFields": "false"})
    body = F.concat(F.substring(res, F.lit(1), F.length(res) - 1),
                    F.when(F.size("resources") > 0, F.lit(",")).otherwise(F.lit("")),
                    F.lit('"Metadata":'), meta, F.lit("}"))
    key = F.regexp_extract(F.to_json(F.array(F.col("`Group ID`"))), "^\\[(.*)\\]$", 1)
    return report.select(F.col("`Group ID`"), F.concat(F.lit("{"), key, F.lit(":"), body, F.lit("}")).alias(name))


# Test-data shapes -------------------------------------------------------------------------

def hex_groups(supplier: DataFrame) -> DataFrame:
    """Suppliers as groups with ids of the source's form, in five networks."""
    return supplier.select(F.concat(F.lit("sg-"), F.lower(F.hex("s_suppkey"))).alias("GroupId"), F.col("s_name").alias("GroupName"),
                           F.concat(F.lit("vpc-"), F.lower(F.hex((F.col("s_nationkey") % 5).cast("long")))).alias("VPC"))


def nested_customers(customer: DataFrame) -> DataFrame:
    """Customers as resources that name nations as groups: in a list, two levels down, and in a field of their own."""
    nation = F.col("c_nationkey")
    of = lambda c: F.struct(c.cast("string").alias("GroupId"))
    beside = F.array(F.struct(F.array(of(nation), of((nation + 1) % 25)).alias("Groups")), F.struct(F.when(F.col("c_custkey") % 4 == 0, F.array(of((nation + 5) % 25))).alias("Groups")))
    return customer.select(F.col("c_custkey").alias("InstanceId"), F.when(F.col("c_custkey") % 2 == 0, F.array(of(nation))).alias("SecurityGroups"),
                           F.when(F.col("c_custkey") % 5 > 0, beside).alias("NetworkInterfaces"),
                           F.when(F.col("c_custkey") % 3 == 0, ((nation + 2) % 25).cast("string")).alias("MasterGroup"))


CUSTOMER_PATHS = ["SecurityGroups[].GroupId", "NetworkInterfaces[].Groups[].GroupId", "MasterGroup", "AddedLater[]"]


def nested_nations(nation: DataFrame) -> DataFrame:
    """Nations as groups with nested rules: in from the other nations of the region above theirs, out to their own."""
    n = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    pairs = lambda c: F.array(F.struct(F.sort_array(F.collect_list(F.struct(c.cast("string").alias("GroupId")))).alias("UserIdGroupPairs")))
    out = n.groupBy("r").agg(pairs(F.col("k")).alias("rules"))
    into = n.filter("k % 2 = 0").groupBy(((F.col("r") + 1) % 5).alias("r")).agg(pairs(F.col("k")).alias("rules"))
    return (n.join(into.withColumnRenamed("rules", "IpPermissions"), "r", "left").join(out.withColumnRenamed("rules", "IpPermissionsEgress"), "r", "left")
            .select(F.col("k").cast("string").alias("GroupId"), "IpPermissions", F.when(F.col("k") % 3 > 0, F.col("IpPermissionsEgress")).alias("IpPermissionsEgress")))


def supplier_groups(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").cast("string").alias("GroupId"), F.col("s_name").alias("GroupName"),
                           F.col("s_nationkey").cast("string").alias("VPC"))


def nation_groups(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").cast("string").alias("GroupId"), F.col("n_name").alias("GroupName"),
                         F.col("n_regionkey").cast("string").alias("VPC"))


def trade_rules(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Rule rows derived from trade: the customer's nation names the supplier's nation.

    Reduced as early as possible so that ``lineitem`` crosses the network once: each order
    keeps only the set of its suppliers' nations (bounded by the number of nations, also for an
    order holding a third of all lines), that set meets ``orders`` on the order key (the big
    side is already partitioned by it), and customers keep distinct (customer, nation) pairs
    before meeting ``customer``.
    """
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    per_order = (lineitem.select("l_orderkey", "l_suppkey").join(s, "l_suppkey")
                 .groupBy("l_orderkey").agg(F.collect_set("s_nationkey").alias("nations")))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    per_cust = (per_order.join(o, "l_orderkey")
                .select("o_custkey", F.explode("nations").alias("s_nationkey")).distinct())
    c = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    pairs = per_cust.join(c, "o_custkey") \
        .select(F.col("c_nationkey").cast("string").alias("GroupId"), F.lit("ingress").alias("Direction"),
                F.col("s_nationkey").cast("string").alias("ReferencedGroupId"))
    return pairs.distinct()
