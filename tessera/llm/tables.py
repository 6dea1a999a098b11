"""Small shared steps: written intermediate tables, bounded bit sets, connected components."""

from __future__ import annotations

import contextvars
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import scratch_path

#: A batch that goes to a Python worker takes so much in the worker and, several times over, outside of the executor's heap.
BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application; batches are ``BATCH`` long unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_tessera_shipped", False) or not root.is_dir():
        return
    out = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera_package.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(out))
    sc._tessera_shipped = True


def _free() -> None:
    """Unused memory back to the system: a worker waits for its next task while the executor needs memory for other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which give back their memory at a task's end."""
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _free()

    ship(df.sparkSession)
    return df.mapInArrow(freed, schema)


class Scratch:
    """The intermediate tables of one piece of work. Those that ``written`` makes inside ``with Scratch(spark)`` are removed
    at its end, except one handed to ``keep``. Each use has a list of its own, so it never removes another's tables;
    outside of any, tables stay for as long as the shared scratch folder keeps them."""

    _open: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.token = self._open.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._open.reset(self.token)
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows written to a table that outlives this work."""
        return _stored(df, scratch_path(self.spark, name))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: later steps do not depend on
    what executors hold, and each step is computed once."""
    path = scratch_path(df.sparkSession, name)
    own = Scratch._open.get()
    if own is not None:
        own.paths.append(path)
    return _stored(df, path)


def bit_set(values: DataFrame, column: str, bits: int = 23) -> bytes:
    """2^bits bits with the bit of each 64-bit value set: a membership test with false positives only.

    Its size is fixed by ``bits`` whatever the number of values, so it may be sent to every task.
    """
    block = 13
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rows = (values.select(low.alias("bit"))
            .select(F.shiftright("bit", block).alias("block"), F.col("bit").bitwiseAND(F.lit((1 << block) - 1).cast("long")).alias("at")))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(1 << block, np.uint8)
        own[table.column("at").to_numpy()] = 1
        return pa.table({"block": [key[0].as_py()], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = bytearray((1 << bits) // 8)
    size = (1 << block) // 8
    for row in rows.groupBy("block").applyInArrow(packed, "block long, bits binary").collect():
        out[row.block * size:(row.block + 1) * size] = row.bits
    return bytes(out)


def in_bits(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    low = values & np.uint64(8 * len(table) - 1)
    return (table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _is_forest(edges: DataFrame) -> bool:
    """Every node of ``u`` has one edge, to a node that has none itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of the edges; ``component`` is the smallest id reachable.

    Alternating large-star and small-star rounds over the edge table. Each node's least neighbour is a
    partial aggregate, so a hub with very many links is reduced before the shuffle; the join that hands
    it back can be split at run time. Every round is written, and rounds stop when only stars are left.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct())
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "small-star")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def crc_part(column: Column, parts: int) -> Column:
    """crc32 of the number as decimal text, modulo ``parts`` (null: null)."""
    return F.crc32(column.cast("string").cast("binary")) % parts
