"""Property checks (small random inputs, few examples: each example runs Spark jobs)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import EMAIL_PATTERN
from tessera.operators import add_row_index, audit_files, positional_join, upsert

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(-1000, 1000), min_size=0, max_size=60), st.integers(1, 6))
def test_row_index_is_dense_and_follows_order(spark, values, parts):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(parts)
    out = add_row_index(df, "idx", order_by=["v", "i"]).collect()
    assert sorted(r.idx for r in out) == list(range(len(values)))
    by_idx = [(r.v, r.i) for r in sorted(out, key=lambda r: r.idx)]
    assert by_idx == sorted((v, i) for i, v in enumerate(values))


@SETTINGS
@given(st.integers(0, 40), st.integers(0, 40))
def test_positional_join_length_is_min(spark, n, m):
    a = spark.range(n).withColumnRenamed("id", "a")
    b = spark.range(m).withColumnRenamed("id", "b")
    out = positional_join(a, b, "a", "b")
    rows = out.collect()
    assert len(rows) == min(n, m)
    assert all(r.a == r.b for r in rows)


@SETTINGS
@given(st.lists(st.integers(0, 20), max_size=30, unique=True),
       st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), max_size=40))
def test_upsert_keys_are_union_and_last_wins(spark, base_keys, batch):
    base = spark.createDataFrame([(k, -1) for k in base_keys], "k int, v int")
    inc = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch)], "k int, v int, seq int")
    out = dict((r.k, r.v) for r in upsert(base, inc, ["k"], order_by=["seq"]).collect())
    expect = {k: -1 for k in base_keys}
    for k, v in batch:  # later rows win
        expect[k] = v
    assert out == expect


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["f1", "f2", "f3"]), st.one_of(st.none(), st.integers(0, 9))), max_size=50))
def test_audit_valid_plus_null_is_total(spark, rows):
    df = spark.createDataFrame(rows, "file string, id int")
    for r in audit_files(df, "id").collect():
        assert r.valid_rows + r.null_rows == r.total_rows
    total = audit_files(df, "id").filter(F.col("is_total")).first()
    if not rows:  # grouping sets over no rows give no rows at all
        assert total is None
        return
    assert total.total_rows == len(rows)
    assert total.null_rows == sum(1 for _, i in rows if i is None)


# A whole-value match where "$" may stand before one final newline.
SOURCE_RULE = re.compile(f"(^{EMAIL_PATTERN}$)")
TEXT = st.text(alphabet=list("aZ09_.+-@ \n\r,\"ü"), max_size=14)


def _model_hash_email(s):
    import hashlib
    return SOURCE_RULE.sub(lambda m: hashlib.sha256(m.group(1).encode()).hexdigest(), s)


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=80))
def test_hash_email_agrees_with_source_rule(spark, values):
    from tessera.functions import hash_email

    values = values + ["a@b.co", "a@b.co\n", "x.y@z-1.q.r", "a@b.co\n\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.h for r in df.select("i", hash_email("v").alias("h")).collect()}
    assert [got[i] for i in range(len(values))] == [_model_hash_email(v) for v in values]


@SETTINGS
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=40))
def test_csv_writer_and_reader_round_trip(spark, values):
    import tempfile

    from tessera.sinks import write_csv
    from tessera.sources import read_csv

    rows = [(str(i), v) for i, v in enumerate(values) if v != "NA"]
    df = spark.createDataFrame(rows, "i string, v string")
    path = tempfile.mkdtemp(prefix="tessera-rt-") + "/t"
    write_csv(df, path, null_marker="NA")
    back = {r.i: r.v for r in read_csv(spark, path, multi_line=True, null_marker="NA").collect()}
    assert back == dict(rows)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab\n\r \t,é漢😀")), max_size=40)),
                max_size=20))
def test_newlines_to_space_matches_plain_replace(spark, texts):
    from tessera.functions import newlines_to_space
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.v for r in df.select("i", newlines_to_space("v").alias("v")).collect()}
    assert got == {i: (None if t is None else t.replace("\n", " ")) for i, t in enumerate(texts)}
