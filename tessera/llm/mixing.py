"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Every source's documents are hashed into blocks and its blocks put in a permuted order. The target
gives the number of whole passes over a source and the place where its last pass stops, so each source
has an exact quota of block draws. A binary tree over the output shards splits the vector of quotas: at
each node the left half's share is one multivariate hypergeometric draw, seeded by the node, so a shard
finds its own quotas by walking from the root. Shards take disjoint stretches of each source's permuted
blocks and shuffle what they hold by a hash. Runs repeat exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import map_arrow, written

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
BLOCK_DOCS = 64
#: words of a shard, on average: a shard is shuffled by one task
SHARD_WORDS = 4_000_000


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): words of every row's whole text (null: 0)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) by filling to a common level.

    Sources in code point order (null last) weigh ``weights``, repeating. A source takes level * weight
    up to ``most`` times its size; the level is the one at which all targets sum to ``total`` times all
    sizes, which is where sharing out the excess again and again ends. One row per source is sorted.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy()
    upward = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(upward), F.lit(0.0))
    heavier = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upward), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * total - capped) / heavier
    per = per.withColumn("level", level)
    # the first source, by cap / weight, whose own cap is above the level that the rest could share
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(everything)
    per = per.withColumn("fits", fits)
    return per.select("source", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("fits.level") * F.col("weight")), F.col("cap")).alias("target"))


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of each source in a shard, by the path from the root to its leaf."""
    lo, hi, left_of, own = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        middle = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(own.sum())
        n = total * (middle - lo) // (hi - lo)
        left = _draw(rng, own, n)
        if shard < middle:
            own, hi = left, middle
        else:
            left_of, own, lo = left_of + left, own - left, middle
    return left_of, own


def _draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw as a chain of two-colour ones."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, c in enumerate(colours.tolist()):
        rest -= c
        out[i] = k = min(c, n) if rest == 0 else int(rng.hypergeometric(c, rest, n)) if c and n else 0
        n -= k
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL,
        most: float = MOST, shards: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(draws, sizes, targets)``: draws has a row for each time the mix takes a document.

    draws: doc_id, source, size, epoch (from 0), shard, position (a hash that orders the shard). There are as many shards
    as the mix has ``SHARD_WORDS``, unless ``shards`` says otherwise; the words taken do not depend on them. sizes:
    doc_id, source, size of every input row. A null text has size 0; documents of size 0 are drawn like
    others, without changing the sums. Rows that repeat a (doc_id, source) are one document with the sum of
    their sizes. A source's drawn words
    stay below its target by less than the smallest document its last block left out. An empty table gives empty results.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs, doc_id, text, source), "sizes")
    goal = written(targets(sizes, weights, total, most), "targets")
    if shards is None:
        shards = max(1, math.ceil((goal.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    # blocks of a source: as many as hold block_docs documents each on average
    n_blocks = F.ceil(F.col("n_docs") / block_docs)
    keyed = sizes.join(goal.select(F.col("source").alias("s"), n_blocks.alias("n_blocks")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = (keyed.groupBy("doc_id", "source", "n_blocks").agg(F.sum("size").alias("size"))
             .select("doc_id", "source", "size", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "n_blocks").alias("block")))
    keyed = written(keyed, "keyed")
    blocks = keyed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("order", F.xxhash64(F.lit(seed), "block"))
    # running words of the permuted blocks: groups of blocks first, so no task sorts all blocks of a hot source
    blocks = blocks.withColumn("group", F.shiftright("order", 52))
    groups = blocks.groupBy("source", "group").agg(F.sum("words").alias("group_words"), F.count(F.lit(1)).alias("group_blocks"))
    by_group = W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("source", "group", F.coalesce(F.sum("group_words").over(by_group), F.lit(0)).alias("words_before"),
                           F.coalesce(F.sum("group_blocks").over(by_group), F.lit(0)).alias("blocks_before"))
    inside = W.partitionBy("source", "group").orderBy("order", "block")
    ranked = blocks.select("source", "block", "order", "group", "words", F.row_number().over(inside).alias("rank"),
                           F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    placed = (ranked.alias("b").join(groups.alias("g"), F.expr("b.source <=> g.source and b.group = g.group"))
              .selectExpr("b.source", "b.block", "b.words", "b.rank - 1 + g.blocks_before as place", "b.inside + g.words_before as start"))
    placed = written(placed, "blocks")
    # whole passes, and the words of the last, partial one
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    wanted = (placed.alias("b").join(goal.alias("t"), F.expr("b.source <=> t.source"))
              .selectExpr("b.source", "b.block", "b.place", "t.passes", "b.start < t.rest as partial", "b.start + b.words > t.rest as cut", "t.rest - b.start as room"))
    # quotas: one row per source; draw d of a source is pass d div blocks, place d mod blocks
    quota = (wanted.groupBy("source").agg(F.count(F.lit(1)).alias("filled"), F.sum(F.when(F.col("partial"), 1).otherwise(0)).alias("last"), F.first("passes").alias("passes"))
             .select("source", F.expr("filled * passes + last").alias("quota"), "filled"))
    stretches = _stretches(spark, quota, shards, seed)
    drawn = wanted.filter("passes > 0 or partial").select("*", F.explode(F.expr("sequence(0L, passes - if(partial, 0L, 1L))")).alias("epoch"))
    drawn = (drawn.alias("w").join(stretches.alias("s"), F.expr("w.source <=> s.source"))
             .selectExpr("w.source", "w.block", "w.epoch", "w.epoch = w.passes and w.cut as cut", "w.room",
                         "cast(size(filter(s.ends, e -> e <= w.epoch * s.filled + w.place)) as long) as shard"))
    rows = (drawn.alias("w").join(keyed.alias("k"), F.expr("w.source <=> k.source and w.block = k.block"))
            .selectExpr("k.doc_id", "k.source", "k.size", "w.block", "w.epoch", "w.shard", "w.cut", "w.room", f"xxhash64({seed}L, w.epoch, k.doc_id, k.source) as position"))
    columns = ["doc_id", "source", "size", "epoch", "shard", "position"]
    edge = rows.filter("cut").groupBy("source", "block", "epoch").applyInArrow(_fill, rows.schema).select(*columns)
    return rows.filter("not cut").select(*columns).unionByName(edge), sizes, goal.select("source", "source_size", "target")


def _fill(table: pa.Table) -> pa.Table:
    """Of the block where a source's target falls, the documents that still fit, in permuted order."""
    table = table.sort_by([("position", "ascending"), ("doc_id", "ascending")])
    room, keep = table.column("room")[0].as_py(), []
    for i, size in enumerate(table.column("size").to_pylist()):
        if size <= room:
            keep.append(i)
            room -= size
    return table.take(pa.array(keep, pa.int64()))


def _stretches(spark: SparkSession, quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, filled, ends): the draw at which each shard's stretch of a source ends. One task per shard walks the tree.

    The quotas are one row per source: a bound of the sources, not of the documents.
    """
    rows = quota.select("source", "quota", "filled").orderBy(F.asc_nulls_last("source")).toArrow()
    quotas = rows.column("quota").to_numpy().astype(np.int64)
    names = rows.column("source").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    filled = rows.column("filled").to_numpy()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                before, n = shard_quotas(quotas, shards, shard, seed)
                yield pa.record_batch([names, pa.array(filled), pa.array(np.full(len(n), shard)), pa.array(before + n)], names=["source", "filled", "shard", "end"])

    kind = quota.schema["source"].dataType.simpleString()
    leaves = map_arrow(spark.range(shards), walk, f"source {kind}, filled long, shard long, end long")
    ends = F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"])
    return written(leaves.groupBy("source", "filled").agg(ends.alias("ends")), "stretches")


def per_document(draws: DataFrame, sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every input row; ``taken`` counts each draw's words, ``shards`` names
    each draw's shard (a document drawn twice into one shard has it twice)."""
    times = draws.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    return (sizes.alias("d").join(times.alias("t"), F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source"), "left")
            .join(goal.alias("g"), F.expr("d.source <=> g.source"))
            .selectExpr("d.doc_id", "d.size", "g.source_size", "g.target", "d.size * coalesce(cast(size(t.shards) as long), 0L) as taken", "coalesce(t.shards, cast(array() as array<long>)) as shards"))
