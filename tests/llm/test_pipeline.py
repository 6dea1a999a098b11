"""Every stage of the pipeline by itself and the whole run."""

import collections
import os

import corpus_pipeline as p
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, pieces
from tessera.llm.queries import ORACLE, PIECES, TOKENIZERS
from test_operators_llm import plain_language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_return_the_columns_of_documents(spark, docs):
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_language_stage_keeps_clean_documents(spark, docs):
    kept = p.language_id(spark, docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(10 ** 6).cast("long")).withColumn("text", F.lit("123 456"))), SF)
    assert kept.filter(F.col("doc_id") == 10 ** 6).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    assert labels.join(docs, "doc_id").join(kept, "doc_id", "left_anti").count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    copies = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 5000)
    more = docs.unionByName(copies).unionByName(docs.limit(1))
    kept = p.ngram_jaccard_join(spark, more, SF)
    assert kept.filter("doc_id >= 5000").count() == 0
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert kept.count() == p.ngram_jaccard_join(spark, docs, SF).count()


def test_run(spark, docs):
    got = p.run(spark, SF)
    assert got.filter("not round_trip").count() == 0
    assert 0 < got.select("doc_id").distinct().count() <= docs.count()
    assert got.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_empty(spark, docs):
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, shared and missing ids, a very long text, ties, repeated rows and columns with names used inside."""
    long = " ".join(f"word{i % 977}x" for i in range(60_000))
    body = [f"This is text number {i} about the house and the garden of the neighbour {i * i}" for i in range(8)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(body)] + [(3, "Ein anderer Text unter derselben Nummer steht hier", "de", "b", 2), (None, "no id here but some words", None, None, None),
                                                                 (None, None, None, None, None), (50, "", "en", "a", 0), (51, long, "en", "b", 3), (0, body[0], "en", "a", 1)]
    clash = ("__id", "__no", "__cuts", "__source", "__shard", "__at", "__kept", "text_key", "shard", "position", "size", "component_id")
    docs = spark.createDataFrame([(*r, *["own"] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    docs = docs.repartition(3)
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.filter(" or ".join(f"`{c}` <> 'own'" for c in clash)).count() == 0, name
    kept = [(r.doc_id, r.text) for r in p.language_id(spark, docs, SF).collect()]
    assert len(kept) == len(rows) - 2 and (51, long) in kept
    assert p.line_dedup(spark, docs, SF).count() == len(rows)
    ids = [r.doc_id for r in p.ngram_jaccard_join(spark, docs, SF).collect()]
    assert sorted(i for i in ids if i is not None) == [*range(8), 50, 51] and ids.count(None) == 2
    assert [r.text for r in p.ngram_jaccard_join(spark, docs, SF).filter("doc_id = 3").collect()] == [r.text for r in p.ngram_jaccard_join(spark, docs.repartition(5), SF).filter("doc_id = 3").collect()]
    coded = p.sentencepiece(spark, docs, SF)
    assert coded.count() == len(rows) and coded.filter("not round_trip").count() == 0


def test_stages_chained_without_storing(spark, docs):
    """Each stage removes what it wrote itself, so results that are not stored yet stay readable."""
    left = docs
    for _, stage in p.STAGES[:3]:
        left = stage(spark, left, SF)
    assert 0 < left.count() <= docs.count()


def test_run_stage_by_stage_against_plain_versions(spark, docs, tmp_dir):
    """Each stage over what its predecessor stored: language word by word, lines and groups by SQL, quotas by counting, ids by decoding."""
    def stored(name, df):
        path = os.path.join(tmp_dir, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def sql(name, df_path):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{df_path}/*.parquet')")
        return con.execute(ORACLE[name]).fetchall()

    model = langid.Model(langid.fit(docs))
    rows = docs.collect()
    kept = stored("language", p.language_id(spark, docs, SF))
    found = {r.doc_id: plain_language(model, r.text) for r in rows}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (lang, score) in found.items() if lang != "und" and score >= 0.3)

    lines = stored("lines", p.line_dedup(spark, kept, SF))
    gone = collections.defaultdict(set)
    for doc, no, _ in sql("op8_line_dedup", os.path.join(tmp_dir, "language")):
        gone[doc].add(no)
    assert gone
    plain = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in kept.collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == plain

    single = stored("single", p.ngram_jaccard_join(spark, lines, SF))
    assert sorted(r.doc_id for r in single.collect()) == sorted({group for _, _, group in sql("op3_ngram_jaccard_join", os.path.join(tmp_dir, "lines"))})

    mixed = stored("mixed", p.source_mixing(spark, single, SF))
    times, size = collections.Counter(r.doc_id for r in mixed.collect()), {r.doc_id: len(r.text.encode().split()) for r in single.collect()}
    assert set(times) <= set(size) and max(times.values()) <= 2
    source = {r.doc_id: r.source for r in single.collect()}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    taken = collections.Counter()
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert all(taken[k] <= 2 * sizes[k] for k in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.1 * sum(sizes.values())

    coded = p.sentencepiece(spark, mixed, SF)
    text = {r.doc_id: r.text for r in single.collect()}
    decoded = pieces.decode(coded, os.path.join(TOKENIZERS, PIECES)).collect()
    assert collections.Counter(r.doc_id for r in decoded) == times and all(text[r.doc_id] == r.text for r in decoded)
