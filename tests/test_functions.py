import hashlib


from tessera.functions import (hash_email, hash_value, human_size, map_sql_type, newlines_to_space, render_html,
                               render_text, resources_text, valid_format)
from tessera.functions import sql as fsql


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_hash_email_edges(spark):
    vals = ["a@b.com", "a@b.com\n", "x a@b.com", None, "ü@b.com", "a@b.co.", "", "a.b+c@d-e.org",
            "a@b", "a@b.com\n\n", "a@b.com\r\n"]
    got = [r[0] for r in one_col(spark, vals).select(hash_email("v")).collect()]
    assert got == [sha("a@b.com"), sha("a@b.com") + "\n", "x a@b.com", None, "ü@b.com", sha("a@b.co."), "",
                   sha("a.b+c@d-e.org"), "a@b", "a@b.com\n\n", "a@b.com\r\n"]


def test_hash_email_salt_and_value(spark):
    df = one_col(spark, ["a@b.com", None])
    got = [r[0] for r in df.select(hash_email("v", salt="s1")).collect()]
    assert got == [sha("s1a@b.com"), None]
    got = [r[0] for r in df.select(hash_value("v")).collect()]
    assert got == [sha("a@b.com"), None]


def test_newlines_only_lf(spark):
    got = one_col(spark, ["a\nb\r\nc", None]).select(newlines_to_space("v")).collect()
    assert [r[0] for r in got] == ["a b\r c", None]


def test_valid_format_anchors(spark):
    got = one_col(spark, ["sg-0af", "sg-0af\n", "xsg-0af", "sg-XYZ"]).select(valid_format("v", "sg-[0-9a-f]+")).collect()
    assert [r[0] for r in got] == [True, False, False, False]


def test_human_size_boundaries(spark):
    vals = [0, 999, 1000, 1049, 1050, 1150, 1250, 999_999, 10**6, 10**9 - 1, 10**12, 10**15, 10**18]
    got = [r[0] for r in one_col(spark, vals, "long").select(human_size("v")).collect()]
    assert got == ["0B", "999B", "1.0KB", "1.0KB", "1.1KB", "1.2KB", "1.3KB", "1000.0KB", "1.0MB", "1000.0MB",
                   "1.0TB", "1.0PB", "1000.0PB"]


TYPE_CASES = {
    "datetime(6)": "timestamp", "datetime": "timestamp", "int(10) unsigned": "long", "bigint(20) unsigned": "long",
    "bigint(20)": "long", "int(11)": "int", "tinyint(1)": "int", "smallint(6)": "int", "point": "int",
    "date": "date", "varchar(10)": "string", "char(3)": "string", "mediumtext": "string", "text": "string",
    "double": "float", "decimal(10, 2)": "decimal(10,2)", "decimal(8,0)": "decimal(8,0)", "timestamp": "string",
    "float": "string", "json": "string", "enum('print','x')": "int", "set('date')": "date", "time": "string",
}


def test_map_sql_type_rules(spark):
    df = one_col(spark, list(TYPE_CASES))
    got = dict(df.select("v", map_sql_type("v")).collect())
    assert got == TYPE_CASES


def test_render(spark):
    df = spark.createDataFrame([("a<b", None, 3)], "x string, y string, z int")
    r = df.select(render_text("x", "y", "z"), render_html("x", "y", "z")).first()
    assert r[0] == "a<b,,3"
    assert r[1] == "<tr><td>a&lt;b</td><td></td><td>3</td></tr>"


def test_resources_text(spark):
    df = spark.sql("select map('SG', array('g1'), 'EC2', array('i-1','i-2'), 'ELB', array()) as m")
    assert df.select(resources_text("m")).first()[0] == "- EC2 : i-1, i-2\n- SG : g1\n"


def test_sql_functions_match_columns(spark):
    fsql.register(spark)
    vals = ["a@b.com", "a@b.com\n", "x", None]
    df = one_col(spark, vals)
    df.createOrReplaceTempView("fx")
    assert [r[0] for r in spark.sql("select hash_email(v) from fx").collect()] == \
        [r[0] for r in df.select(hash_email("v")).collect()]
    ty = one_col(spark, list(TYPE_CASES))
    ty.createOrReplaceTempView("ty")
    assert dict(spark.sql("select v, map_sql_type(v) from ty").collect()) == TYPE_CASES
    plan = spark.sql("select human_size(length(v)) from fx")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_scale_settings():
    from tessera.session import scale_settings

    s = scale_settings(100 * 10**12, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert s["spark.sql.adaptive.skewJoin.enabled"] == "true"
