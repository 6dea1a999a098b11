"""J1 scrub_table: shape a table, hash e-mail addresses, flatten newlines, write CSV + Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hash_email, newlines_to_space
from tessera.operators.projection import add_constant, apply_mapping, drop_null_fields, make_struct
from tessera.plans.file_copies import publish
from tessera.sinks.files import write_dual
from tessera.sources.catalog import read_table
from tessera.sources.files import read_csv

# The source job's five-column mapping (source name, source type, target name, target type).
DEFAULT_MAPPING = [
    ("col1", "string", "col1", "string"),
    ("col2", "long", "col2", "long"),
    ("col3", "string", "col3", "string"),
    ("col4", "string", "col4", "string"),
    ("col5", "long", "col5", "long"),
]


def scrub(df: DataFrame, mapping: Sequence[tuple[str, str, str, str]] = DEFAULT_MAPPING,
          email_cols: Sequence[str] = ("col3",), newline_cols: Sequence[str] = ("col4",),
          constant: tuple[str, object] | None = ("col0", 1), salt: str | None = None) -> DataFrame:
    """C3 -> C1/C2 -> C6 -> C8 as one projection (no shuffle, no Python worker)."""
    shaped = apply_mapping(df, mapping)
    if constant is not None:
        shaped = add_constant(shaped, constant[0], constant[1], first=True)
    cols = []
    for c in shaped.columns:
        e = F.col(f"`{c}`")
        if c in email_cols:
            e = hash_email(e, salt)
        if c in newline_cols:
            e = newlines_to_space(e)
        cols.append(e.alias(c))
    return shaped.select(*cols)


def run(spark: SparkSession, database: str | None, table: str, result_base: str, result_database: str, publish_root: str | None = None,
        mixed: dict[str, Sequence[str]] | None = None, **scrub_args) -> tuple[DataFrame, DataFrame]:
    """Whole job from the catalog table: scrub, mixed columns to structs (``mixed``: column -> types), null fields dropped, then
    Parquet and CSV under ``{base}/{db}_parquet|_csv/{table}`` and, with ``publish_root``, copies of both under their
    published names. Returns what was written, read back: (Parquet rows, CSV rows as text; structs as JSON).
    """
    shaped = scrub(read_table(spark, database, table), **scrub_args)
    for name, types in (mixed or {}).items():
        shaped = make_struct(shaped, name, types)
    cleaned = drop_null_fields(shaped)
    csv_path, parquet_path = write_dual(cleaned, result_base, result_database, table)
    if publish_root:
        for kind in ("csv", "parquet"):
            publish(spark, result_base, result_database, publish_root, kind)
    return spark.read.parquet(parquet_path), read_csv(spark, csv_path, multi_line=True)


def customer_input(customer: DataFrame) -> DataFrame:
    """Test-data shape for J1 from ``customer``: an e-mail column derived from the name (every
    seventh key keeps the plain name, which must pass through) and a two-line text column."""
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return customer.select(
        F.col("c_name").alias("col1"),
        F.col("c_custkey").alias("col2"),
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(email).alias("col3"),
        F.concat(F.col("c_mktsegment"), F.lit("\n"), F.col("c_name")).alias("col4"),
        F.col("c_nationkey").cast("long").alias("col5"),
    )


def documents_input(documents: DataFrame) -> DataFrame:
    """Test-data shape for J1 from ``documents``: whole texts (with newlines) in col4."""
    return documents.select(
        F.col("lang").alias("col1"),
        F.col("doc_id").alias("col2"),
        F.col("source").alias("col3"),
        F.col("text").alias("col4"),
        F.col("n_chars").alias("col5"),
    )


# The mapping of the test-data shape below: the five columns and two nested ones with fields that hold nothing.
NESTED_MAPPING = [*DEFAULT_MAPPING, ("col6", "array<struct<n:int,none:void>>", "col6", "array<struct<n:int,none:void>>"),
                  ("col7", "map<string,struct<n:int,none:void>>", "col7", "map<string,struct<n:int,none:void>>"), ("col8", "array<void>", "col8", "array<void>")]


def nested_input(customer: DataFrame) -> DataFrame:
    """``customer_input`` with a first column of mixed content and nested columns with fields that hold nothing."""
    rows = customer_input(customer)
    mixed = F.when(F.col("col2") % 3 == 0, F.col("col2").cast("string")).otherwise(F.col("col1"))
    nation = F.col("col5").cast("int").alias("n")
    return rows.select(mixed.alias("col1"), "col2", "col3", "col4", "col5", F.array(F.struct(nation, F.lit(None).alias("none"))).alias("col6"),
                       F.create_map("col3", F.struct(nation, F.lit(None).alias("none"))).alias("col7"), F.array(F.lit(None)).alias("col8"))
