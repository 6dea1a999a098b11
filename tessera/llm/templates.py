"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its number of tokens and its leading tokens; tokens with a digit are variable fields.
That pair names a leaf of the tree. Inside a leaf each position's most frequent token forms the leaf's
template; lines that agree with it in ``similar`` of their positions take it, with the positions where
they differ generalised, and the others stand for themselves. Lines of a template that recurs across
``min_documents`` documents are dropped.

Every document counts, copies and near copies as one: a document with a fifth of its words in lines whose leaf no other
document has counts as itself, any other one as the document that first holds most of its words. However many copies there
are, they do not make their lines recurring ones; that is the near-duplicate join's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import bit_set, in_bits, map_arrow, ship, written

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
DEPTH = 3
SIMILAR = 0.7
MIN_DOCUMENTS = 10
#: share of a document's words, one in so many, that makes it no copy (the near-duplicate join's 80 % from the other side)
OWN_ONE_IN = 5
#: parts into which the lines of a leaf are dealt when they meet its template
SLICES = 32


def masked(line: Column) -> Column:
    """The lower-cased line with tokens that hold a digit replaced by the field mark; most lines have no digit to look for."""
    low = F.lower(line)
    fields = F.regexp_replace(low, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
    return F.btrim(F.when(line.rlike("[0-9]"), fields).otherwise(low), F.lit(" \t\n\x0b\x0c\r"))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_key, no, leaf, line, n, masked) of every line with a token: ``text_key`` is a digest of id and text,
    the leaf one of the token count and the leading tokens, ``line`` one of all masked tokens."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("text_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    rows = rows.select("doc_id", "text_key", "no", masked(F.col("line")).alias("masked")).filter("masked <> ''")
    rows = rows.select("*", F.split("masked", SPACE).alias("tokens"))
    return rows.select("doc_id", "text_key", "no", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"),
                       F.xxhash64(F.lit(1), F.col("tokens")).alias("line"), F.size("tokens").alias("n"), "masked")


def voices(parsed: DataFrame) -> DataFrame:
    """(text_key, voice): the document that each document counts as, itself or the one that it is a copy of."""
    held = written(parsed.groupBy("leaf", "doc_id", "text_key").agg(F.sum("n").alias("n")), "held")
    leaves = held.groupBy("leaf").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("holders"))
    shares = (held.join(leaves, "leaf").groupBy("text_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
              .agg(F.sum("n").alias("words"), F.sum(F.when(F.col("holders") == 1, F.col("n")).otherwise(0)).alias("own")))
    best = shares.groupBy("text_key").agg(F.min(F.struct(-F.col("words"), "first_id", "first_key")).alias("most"), F.sum("words").alias("words"), F.sum("own").alias("own"))
    return best.select("text_key", F.when(F.col("own") * OWN_ONE_IN >= F.col("words"), F.col("text_key")).otherwise(F.col("most.first_key")).alias("voice"))


def _likely(bits: bytes) -> Callable:
    table = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(batch.column("leaf").to_numpy().view(np.uint64), table)))

    return run


def recurring(parsed: DataFrame, similar: float = SIMILAR, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(leaf, line, template, documents) digests of the lines whose template recurs.

    Counts of documents are exact: a line's rows are first reduced to its distinct voices, spread by both. Leaves that can't
    hold a recurring template are left out before any token crosses the network, by a bit set of fixed size (it lets
    some pass, which the join takes out).
    """
    pairs = written(parsed.select("leaf", "line", "text_key").join(written(voices(parsed), "voices"), "text_key").select("leaf", "line", "voice").distinct(), "pairs")
    busy = (pairs.select("leaf", "voice").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("k"))
            .filter(F.col("k") >= min_documents).select("leaf"))
    busy = written(busy, "busy")
    ship(parsed.sparkSession)
    # one row per different line of the leaves that can hold a recurring template
    shapes = parsed.select("leaf", "line", "n", "masked")
    likely = map_arrow(shapes, _likely(bit_set(busy, "leaf")), shapes.schema)
    kinds = likely.groupBy("leaf", "line").agg(F.first("masked").alias("masked"), F.first("n").alias("n")).join(busy, "leaf", "left_semi")
    kinds = written(kinds.select("leaf", "line", "n", F.split("masked", SPACE).alias("tokens"), F.pmod("line", F.lit(SLICES)).alias("part")), "kinds")
    cells = kinds.select("leaf", F.posexplode("tokens").alias("at", "token"))
    votes = cells.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("votes"))
    major = votes.groupBy("leaf", "at").agg(F.max_by("token", F.struct("votes", "token")).alias("major"))
    shape = major.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "major"))), lambda x: x["major"]).alias("shape"))
    shape = written(shape, "shapes").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    agree = F.aggregate(F.zip_with("tokens", "shape", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    placed = (kinds.join(shape, ["leaf", "part"])
              .select("leaf", "line", F.when(agree >= F.col("n") * similar, F.col("leaf")).otherwise(F.col("line")).alias("template")))
    placed = written(placed, "placed")
    uses = (pairs.join(placed, ["leaf", "line"]).select("template", "voice").distinct()
            .groupBy("template").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= min_documents))
    return written(placed.join(uses, "template").select("leaf", "line", "template", "documents"), "recurring")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
                  similar: float = SIMILAR, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, no, template, documents): the line numbers (from 0) of every document that are dropped.

    Null and empty texts have no lines. Rows that repeat an id and a text are one document; rows that share an id (or
    have none) with different texts are different ones. Ties of a position's vote go to the greater token. Lines of any
    length are compared whole. An empty table gives no rows; other columns are not read.
    """
    parsed = written(lines(docs, doc_id, text, depth), "parsed")
    return (parsed.select("doc_id", "text_key", "no", "leaf", "line").join(recurring(parsed, similar, min_documents), ["leaf", "line"])
            .select("doc_id", "text_key", F.col("no").cast("long").alias("no"), "template", "documents").distinct())


def without_lines(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their dropped lines; every row and every other column stays.

    Only rows with both the id and the text of a dropped line are cut. A text whose lines all go becomes empty.
    """
    cuts = (dropped.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_key").alias("__cut_key"))
            .agg(F.collect_set(F.col("no").cast("int")).alias("__no")).alias("__c"))
    t, no = F.col(f"__d.`{text}`"), F.col("__c.__no")
    gone = F.map_from_arrays(no, F.transform(no, lambda x: F.lit(True)))
    left = F.element_at(F.transform(F.array(gone), lambda m: F.array_join(
        F.filter(F.split(t, "\n"), lambda x, i: F.element_at(m, i).isNull()), "\n")), 1)
    same = (F.xxhash64(F.col(f"__d.`{doc_id}`"), t) == F.col("__c.__cut_key")) & F.col(f"__d.`{doc_id}`").eqNullSafe(F.col("__c.__cut_id"))
    joined = docs.alias("__d").join(cuts, same, "left")
    return joined.select(*[F.when(no.isNull(), t).otherwise(left).alias(text) if c == text else F.col(f"__d.`{c}`") for c in docs.columns])
