"""Corpus pipeline: documents through five operators, each stage written as Parquet and read again.

A stage decides by small tables (lines to drop, ids to keep, draws); it stores these, removes what it wrote on the way, and joins
them to its documents. Documents are told apart by id and text, so rows that share an id or have none are
treated each by itself. Columns beside doc_id, text, lang and source are passed on, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jaccard, langid, mixing, pieces, templates
from tessera.llm.queries import PIECES, TOKENIZERS
from tessera.llm.tables import Scratch
from tessera.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: a null or empty text, one without a letter, or a score below 0.3.

    Equal texts are judged alike; a text is read whole, however long. An empty table gives an empty one.
    """
    with Scratch(spark):
        model = langid.fit(docs)
    return langid.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines of recurring templates from the texts; every document stays.

    Null and empty texts stay as they are; a text whose lines all go becomes empty. Repeated rows are cut alike, and rows that
    share an id but not a text each by its own lines. Lines of any length are compared whole.
    """
    with Scratch(spark) as own:
        dropped = own.keep(templates.dropped_lines(docs).select("doc_id", "text_key", "no"), "dropped-lines")
    return templates.without_lines(docs, dropped)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Rows with a null doc_id are in no group and stay; of rows that repeat a doc_id the one with the least digest of
    its columns stays. A null or empty text links with nothing and stays.
    """
    with Scratch(spark) as own:
        groups = jaccard.near_duplicates(docs)
        kept = own.keep(groups.filter("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = known.groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*plain)).alias("row")).select("row.*")
    return one.unionByName(docs.filter("doc_id is null"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, by shard and, within a shard, in shuffled order.

    A null source is a source of its own; a null or empty text has no words and is drawn like others. Rows that repeat an id and
    a source are drawn together.
    """
    with Scratch(spark) as own:
        draws, _, _ = mixing.mix(docs)
        draws = own.keep(draws.select("doc_id", "source", "shard", "position"), "draws").alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.source").eqNullSafe(F.col("w.source"))
    mixed = docs.alias("d").join(draws, same).repartition("w.shard").sortWithinPartitions("w.shard", "w.position")
    return mixed.select(*[F.col(f"d.`{c}`") for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token ids of every document of the mix, with its source and language (a null text has null ids, an empty one none)."""
    return pieces.encode(docs, os.path.join(tokenizers, PIECES), carry=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Hashing, sampling and the search over pieces have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
