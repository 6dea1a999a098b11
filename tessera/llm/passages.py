"""Substring dedup: hashed sentences and lines, grouped by digest over all documents.

A unit is a line or, within a line, what ends with a full stop, exclamation or question mark before a blank; one of more
than ``LONG_UNIT`` words is cut further, after every word of ten characters or more, so that a passage without sentence ends
is cut alike wherever it stands. Each unit is normalised (lower case, single spaces) and hashed. Of equal units the earliest by
(document, unit) stays; a run of consecutive later copies with ``min_words`` words or more is removed: a passage that begins
and ends within sentences is found by the whole units inside it, and short sentences that texts share by chance stay. The rows
give the original offsets (code points, end exclusive) of what goes and the place of the copy that stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_arrow, written
from tessera.llm.words import slices

MIN_WORDS = 25
LONG_UNIT = 16
SPACE = " \t\n\x0b\x0c\r"
#: the blank after a sentence becomes a line end, so that offsets stay
_SENTENCE = re.compile(r"([.!?])[\x20\x09\x0B-\x0D]")
_LONG_WORD = re.compile(r"([^\x20\x09-\x0D]{10,})[\x20\x09\x0B-\x0D]")


def pieces_of(text: str) -> Iterator[tuple[str, list[bytes]]]:
    """The units of a text, one after the other with a character between them, and the words of each."""
    for line in _SENTENCE.sub("\\1\n", text).split("\n"):
        words = line.encode().lower().split()
        if len(words) <= LONG_UNIT:
            yield line, words
        else:
            for part in _LONG_WORD.sub("\\1\n", line).split("\n"):
                yield part, part.encode().lower().split()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            of, no, start, end, n_words, digests = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, unit = 0, 0
                for line, words in pieces_of(text or ""):
                    if words:
                        digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                        s = at + len(line) - len(line.lstrip(SPACE))
                        of.append(i)
                        no.append(unit)
                        start.append(s)
                        end.append(s + len(line.strip(SPACE)))
                        n_words.append(len(words))
                        unit += 1
                    at += len(line) + 1
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = batch.select(["doc_id", "text_key"]).take(pa.array(of, pa.int64()))
            yield pa.record_batch([*rows.columns, *(pa.array(x, pa.int64()) for x in (no, start, end, n_words)), *(pa.array(np.ascontiguousarray(two[:, k])) for k in range(2))],
                                  names=["doc_id", "text_key", "unit", "start", "end", "n_words", "high", "low"])


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The units with a word of every text: digest of id and text, number, offsets, words and a 128-bit digest of the normal form."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("text_key"))
    fields = [T.StructField(n, T.LongType()) for n in ("text_key", "unit", "start", "end", "n_words", "high", "low")]
    return map_arrow(source, _units, T.StructType([source.schema["doc_id"], *fields]))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: doc_id, text_key, unit, start, end, n_words, run_words, kept_doc_id, kept_start.

    Documents rank by ``doc_id`` (null first), those that share an id by their texts' digests. Null and empty texts have no units. Rows that
    repeat an id and a text are one document read twice: their units rank equal, and each row is cut alike. A unit
    repeated inside one document counts like any other. Other columns are not read. The group of a digest is only
    ever a partial minimum; no task holds a group's members. An empty table gives no rows.
    """
    found = written(units(docs, doc_id, text), "units")
    place = F.struct(F.col("doc_id"), F.col("text_key"), F.col("unit"))
    first = (found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "text_key", "unit", "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
             .filter("copies > 1").drop("copies"))
    # a table of its own: a digest that a third of the documents hold can then be split where it is joined
    first = written(first, "first")
    later = found.join(first, ["high", "low"]).filter(place > F.struct("first.doc_id", "first.text_key", "first.unit"))
    later = later.repartition("text_key", "doc_id").distinct()  # a text read twice
    in_text = W.partitionBy("text_key", "doc_id")
    islands = later.withColumn("island", F.col("unit") - F.row_number().over(in_text.orderBy("unit")))
    runs = islands.withColumn("run_words", F.sum("n_words").over(W.partitionBy("text_key", "doc_id", "island")))
    return (runs.filter(F.col("run_words") >= min_words)
            .select("doc_id", "text_key", "unit", "start", "end", "n_words", "run_words",
                    F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")))


def cleaned(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the removed spans cut out of ``text``; all other columns stay as they are. Only rows with
    both the id and the text of a removal are cut."""
    cuts = (removed.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_key").alias("__cut_key"))
            .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cuts")).alias("__c"))
    t = F.col(f"__d.`{text}`")
    gone = F.col("__c.__cuts")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda c: c["end"]))
    starts = F.concat(F.transform(gone, lambda c: c["start"]), F.array(F.length(t).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                                    lambda x: F.substring(t, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")
    own = F.xxhash64(F.col(f"__d.`{doc_id}`"), t)
    joined = docs.alias("__d").join(cuts, (own == F.col("__c.__cut_key")) & F.col(f"__d.`{doc_id}`").eqNullSafe(F.col("__c.__cut_id")), "left")
    return joined.select(*[F.when(gone.isNull(), t).otherwise(kept).alias(text) if c == text else F.col(f"__d.`{c}`") for c in docs.columns])
