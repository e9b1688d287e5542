"""The engine on small tables: NULLs, dates, errors, plans."""

import calendar
import datetime
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnade.functions.spec import user_function
from columnade.operators import Engine
from columnade.plans.errors import AnalysisError
from columnade.sources import json_document, json_table


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def people(spark):
    columns = [{"name": "id", "type": "STRING"}, {"name": "n", "type": "INT"}, {"name": "x", "type": "DOUBLE"}, {"name": "s"}, {"name": "d", "type": "DATETIME"}, {"name": "b", "type": "BOOL"}]
    rows = [
        {"id": "1", "n": 10, "x": -1.5, "s": "Alice", "d": "2024-01-31T10:00:00Z", "b": True},
        {"id": "2", "n": 20, "x": 2.5, "s": "alex", "d": 1700000000, "b": False},
        {"id": "3", "n": None, "s": "", "d": 0},
        {"id": "4", "n": 40, "x": 0.0, "s": "B\\c d", "d": "1999", "b": True},
    ]
    return json_table(spark, columns, rows).cache()


def ids(engine, df, text):
    return "".join(sorted(r.id for r in engine.filter(df, text).collect()))


@pytest.mark.parametrize(("text", "want"), [
    (None, "1234"), ("n > 10", "24"), ("s BETWEEN 'ALEX' AND 'alice'", "12"), ("s NOT IN ('ALICE')", "234"), ("s IN ('ALICE')", "1"),
    ("n NOT IN (10, NULL)", "234"), ("n IN (10, NULL)", "1"), ("n NOT BETWEEN 5 AND 15", "24"), ("s NOT LIKE 'a%'", "4"), ("s LIKE 'a c'", ""), ("s LIKE 'b c_d'", "4"),
    ("s LIKE 'b\\c d'", "4"), ("b IS NOT TRUE", "23"), ("NOT b", "2"), ("b IS FALSE OR n IS NULL", "23"), ("n < 15 OR TRUE", "1234"), ("n < 15 OR b", "14"), ("n < 15 OR x > 2", "12"),
    ("d = '2024-01-31 10:00:00'", "1"), ("d + 1 = 1700086400", "2"), ("d - d = 0", "124"), ("YEAR(d) = 1999", "4"), ("n = 10.5", ""), ("n < 10.5", "1"), ("x = '2.5'", "2"),
    ("n IS NULL", "3"), ("NULL IS NULL", "1234"), ("n = NULL", ""), ("s = ''", ""), ("-n < -15", "24"), ("(n + 10) * 2 > 50", "24"), ("n::STRING = '10'", "1"),
])
def test_filters(engine, people, text, want):
    assert ids(engine, people, text) == want


def test_compat_cuts_fractions(spark, people):
    assert ids(Engine(spark, compat=True), people, "n < 10.5") == ""


def value(engine, text):
    return engine.value(text)


@pytest.mark.parametrize(("text", "want"), [
    ("1 / 2", 0.5), ("1 / 0", None), ("'a' + 'b'", "ab"), ("CONCAT(NULL, 'a', 1)", "a1"), ("CONCAT('', NULL)", None), ("LENGTH('é')", 2), ("SUBSTR('abc', 0)", None),
    ("SUBSTR('abc', 2)", "bc"), ("SUBSTR('abc', 2, 9)", "bc"), ("SUBSTR('abc', 4)", None), ("SUBSTR('abc', 1, -1)", None), ("RTRIM('   ')", ""), ("TRIM('  a\t ')", "a\t"),
    ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("FLOOR(-1.5)", -2.0), ("CEIL(1.2)", 2.0), ("SUM(NULL, NULL)", 0.0), ("SUM(1, 2.5, NULL)", 3.5), ("AVG(1, 2)", 1.5), ("AVG(1, NULL)", None),
    ("MIN('b', 'B', 'a')", "a"), ("MIN('B', 'b')", "B"), ("MAX('B', 'b')", "B"), ("MAX(-2.0, -3.0)", -2.0), ("MIN(1, NULL)", None), ("'12abc'::INT", 12), ("' -1.5e1x'::DOUBLE", -15.0),
    ("'false'::BOOL", False), ("'perhaps'::BOOL", None), ("1.5::STRING", "1.500000"), ("TRUE::STRING", "true"), ("5::BOOL", True), ("-2.7::INT", -2), ("COALESCE(NULL, 1, 2.5)", 1.0),
    ("EXTRACT(WEEK FROM '2021-01-03')", 53), ("DOW('2021-01-03')", 0), ("ISODOW('2021-01-03')", 7), ("DATEPART('doy', '2021-02-01')", 32), ("1 = 1 AND 2 < 1", False), ("5 BETWEEN 1 AND 9", True),
])
def test_values(engine, text, want):
    assert value(engine, text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("TIMESTAMP '2024-01-31' + INTERVAL '1 month'", "2024-03-02 00:00:00"), ("TIMESTAMP '2024-03-31' - INTERVAL '1 month'", "2024-03-02 00:00:00"),
    ("TIMESTAMP '2024-01-01' + INTERVAL P1DT2H", "2024-01-02 02:00:00"), ("DATE_TRUNC('week', TIMESTAMP '2024-01-03')", "2023-12-31 00:00:00"),
    ("DATE_TRUNC('decade', TIMESTAMP '1999-05-05')", "1990-01-01 00:00:00"), ("DATE_TRUNC('century', TIMESTAMP '2024-05-05')", "2000-01-01 00:00:00"),
    ("DATE_TRUNC('millennium', TIMESTAMP '2024-05-05')", "2000-01-01 00:00:00"), ("CONVERT_TZ(TIMESTAMP '2024-07-01 12:00:00', 'America/New_York')", "2024-07-01 08:00:00"),
    ("CONVERT('DATETIME', 1700000000)", "2023-11-14 22:13:20"), ("TIMESTAMP '2024-01-01' + 1.5", "2024-01-02 12:00:00"),
])
def test_dates(engine, spark, text, want):
    got = spark.range(1).select(engine.compile(text, T.StructType([])).column().cast("string")).first()[0]
    assert got == want


def test_millennium_compat(spark):
    got = spark.range(1).select(Engine(spark, compat=True).compile("DATE_TRUNC('millennium', TIMESTAMP '2024-05-05')", T.StructType([])).column().cast("string")).first()[0]
    assert got == "1900-01-01 00:00:00"


def test_months_run_over_like_a_calendar_clock(engine, spark):
    rng = random.Random(3)
    cases = [(datetime.datetime(rng.randint(1971, 2060), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23)) + datetime.timedelta(days=rng.randint(0, 3)), rng.randint(0, 40)) for _ in range(60)]
    df = spark.createDataFrame([(i, d.replace(tzinfo=datetime.timezone.utc), m) for i, (d, m) in enumerate(cases)], "i int, d timestamp, m int")
    for months in sorted({m for _, m in cases})[:6]:
        got = {r.i: r.v for r in engine.project(df.where(F.col("m") == months), {"v": f"(d + INTERVAL '{months} months')::STRING"}, ["i"]).collect()}
        for i, text in got.items():
            d = cases[i][0]
            year, month = divmod(d.year * 12 + d.month - 1 + months, 12)
            want = calendar.timegm((year, month + 1, 1, d.hour, 0, 0)) + (d.day - 1) * 86400
            assert text == (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=want)).strftime("%Y-%m-%dT%H:%M:%S")


@pytest.mark.parametrize("text", ["nope = 1", "n + d", "AND_(n)", "n AND b", "CONVERT_TZ(d, 'Mars/Base')", "DATE_TRUNC('fortnight', d)", "d::INT", "EXTRACT(ERA FROM d)", "TIMESTAMP 'soon' = d", "SUBSTR(s)", "d = 'soon'"])
def test_analysis_errors(engine, people, text):
    with pytest.raises(AnalysisError):
        engine.filter(people, text)


def test_all_findings_at_once(engine, people):
    with pytest.raises(AnalysisError) as e:
        engine.filter(people, "nope = 1 AND never = 2")
    assert len(e.value.messages) == 2


@pytest.mark.parametrize(("text", "pushed"), [
    ("l_shipdate >= '1997-01-01'", "GreaterThanOrEqual(l_shipdate"), ("l_quantity < 10 OR l_tax > 0.05", "Or(LessThan(l_quantity,10.0)"),
    ("l_returnflag = 'a'", "In(l_returnflag, [A,a])"), ("l_linenumber BETWEEN 2 AND 3", "GreaterThanOrEqual(l_linenumber,2)"),
])
def test_filters_reach_the_scan_without_python(engine, spark, sf_dir, text, pushed):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = engine.filter(df, text).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters")[1] and "Python" not in plan and "Exchange" not in plan and "l_extendedprice" not in plan


def test_register_reserve_and_columns(spark, people):
    engine = Engine(spark)
    engine.register(user_function("TWICE", ("INT",), "INT", lambda c: c * 2, "double"))
    engine.reserve("tenant")
    assert ids(engine, people, "TWICE(n) = 40") == "2"
    assert "TWICE" in engine.functions() and len(engine.functions()) > 67
    assert ids(engine, people, "id = '1'") == "1"
    assert "".join(r.id for r in engine.filter(people, "n = 11", columns={"n": F.col("n") + 1}).collect()) == "1"


def test_explain(engine, people):
    said = engine.explain("n > 1 AND 1 = 1", people.schema)
    assert "== Bound ==" in said and said.rstrip().endswith("INT 1")


def test_documents(engine, spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('{"table": {"name": "t", "columns": [{"name": "id"}, {"name": "v", "type": "INT"}], "rows": [{"id": "a", "v": 1}, {"id": "b"}]}, "queries": [{"sql": "v = 1", "expected": ["a"]}]}')
    df, asked = json_document(spark, path)
    assert [r.id for r in engine.filter(df, asked[0]["sql"]).collect()] == asked[0]["expected"]


_TRUTH = {"a": (True, False, None), "b": (True, False, None)}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(st.sampled_from(["a", "b", "c"]), lambda inner: st.one_of(st.tuples(st.sampled_from(["AND", "OR"]), inner, inner), st.tuples(st.just("NOT"), inner)), max_leaves=6))
def test_strict_logic_like_a_small_evaluator(spark, engine, tree):
    values = [True, False, None]
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in values for b in values for c in values)]
    df = spark.createDataFrame(rows, "i int, a boolean, b boolean, c boolean")

    def text(t):
        return t if isinstance(t, str) else f"(NOT {text(t[1])})" if t[0] == "NOT" else f"({text(t[1])} {t[0]} {text(t[2])})"

    def run(t, row):
        if isinstance(t, str):
            return row["abc".index(t) + 1]
        if t[0] == "NOT":
            v = run(t[1], row)
            return None if v is None else not v
        p, q = run(t[1], row), run(t[2], row)
        return None if p is None or q is None else (p and q if t[0] == "AND" else p or q)

    want = [(r[0], run(tree, r)) for r in rows]
    assert sorted((r.i, r.v) for r in engine.project(df, {"v": text(tree)}, ["i"]).collect()) == want
    assert sorted(r.i for r in engine.filter(df, text(tree)).collect()) == [i for i, v in want if v]


@pytest.mark.parametrize("text, wrong", [("{} + 1", "2147483647"), ("{} * 2", "-2147483648")])
def test_overflow_of_constants_and_columns(spark, text, wrong):
    """A constant that leaves INT raises as a column does, instead of growing."""
    engine, df = Engine(spark), spark.createDataFrame([(int(wrong),)], "n int")
    for expression in (text.format("n"), text.format(wrong)):
        with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
            engine.project(df, {"v": expression}).collect()
    assert engine.value("2147483646 + 1") == 2147483647 and engine.value("9999999999 + 1") == 10000000000


def test_conversions_of_constants_and_columns(spark):
    """Constants and columns agree at the ends of what a type holds."""
    texts = ["2147483647", "2147483648", " -2147483648x", "-2147483649", "12.9", "x"]
    numbers = [2147483647.5, 2147483648.0, -2147483648.9, -3e9, float("nan"), 1e300]
    engine = Engine(spark)
    df = spark.createDataFrame(list(zip(texts, numbers, strict=True)), "s string, d double")
    got = engine.project(df, {"i": "s::INT", "j": "d::INT"}).collect()
    assert [r.i for r in got] == [engine.value(f"'{x}'::INT") for x in texts]
    assert [r.j for r in got][:4] + [None] == [engine.value(f"({x!r})::INT") for x in numbers[:4]] + [None]


DATES = [
    ("2024", "2024-01-01 00:00:00"), ("2024-3", "2024-03-01 00:00:00"), (" 2024-03-09 ", "2024-03-09 00:00:00"), ("2024-03-09T7", "2024-03-09 07:00:00"),
    ("2024-03-09x07:08", "2024-03-09 07:08:00"), ("2024-03-09 07:08:09.25", "2024-03-09 07:08:09"), ("2024-03-09T07:08:09Z", "2024-03-09 07:08:09"),
    ("2024-03-09T07:08:09 +0130", "2024-03-09 05:38:09"), ("2024-03-09T07:08:09-10:00", "2024-03-09 17:08:09"), ("3-9-2024 1:2", "2024-03-09 01:02:00"),
    ("3-2024", "2024-03-01 00:00:00"), ("2024-13-01", None), ("2024-02-30", None), ("2024-01-01 24:00", None), ("2024-01-01 10:61", None), ("2024-01-01 10:10:60", None),
    ("0000-01-01", None), ("", None), ("nothing", None), ("\u0001|2024|1|1", None), ("20240101", None),
]


def test_dates_in_text(spark):
    """Each form of a date, as a column and as a constant."""
    engine = Engine(spark)
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(DATES)], "i int, s string")
    got = [r.v for r in engine.project(df, {"v": "(s::DATETIME)::STRING"}, ["i"]).orderBy("i").collect()]
    want = [None if at is None else at.replace(" ", "T") for _, at in DATES]
    assert got == want
    from columnade.plans.convert import datetime_text
    from columnade.plans.types import parse_datetime

    assert [None if parse_datetime(text) is None else datetime_text(parse_datetime(text)) for text, _ in DATES] == want


def test_json_rows(spark, tmp_path):
    """Rows one a line, as one list over lines, and none at all."""
    from columnade.sources import json_documents, json_rows, write_ids

    definition = tmp_path / "definition.json"
    definition.write_text('{"columns": [{"name": "id", "type": "STRING"}, {"name": "n", "type": "INT"}, {"name": "other", "type": "BLOB"}]}')
    for k, text in enumerate(('{"id": "a", "n": 1}\n\n{"id": "b", "extra": 2}\n', '\n[\n{"id": "a",\n "n": 1},\n{"id": "b"}]', "")):
        rows = tmp_path / f"rows{k}.json"
        rows.write_text(text)
        df = json_rows(spark, str(definition), str(rows))
        assert [(r.id, r.n, r.other) for r in df.collect()] == ([("a", 1, None), ("b", None, None)] if text else [])
    write_ids(df, str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).count() == 0
    assert list(json_documents(spark, tmp_path / "nothing")) == []


def test_equality_of_texts_reaches_the_scan(spark, sf_dir):
    """Short constants become lists of spellings, for the same rows as lower case; long ones stay."""
    engine, df = Engine(spark), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = lambda text: engine.filter(df, text)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_returnflag, [A,a])" in plan("l_returnflag = 'a'") and "In(l_returnflag, [A,N,a,n])" in plan("l_returnflag IN ('N', 'a')")
    assert "lower(l_returnflag" in plan("l_returnflag = 'abcdef'")
    words = ["k", "K", "\u212a", "ok", "OK", "o\u212a", "x", "", "\u0130", "i", "I", None]
    people = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, w string")
    for text in ("w = 'k'", "'OK' = w", "w != 'ok'", "w IN ('k', 'i')", "w NOT IN ('k', 'i')", "w = ''", "w IN ('', 'x')"):
        short = sorted(r.id for r in engine.filter(people, text).collect())
        whole = sorted(r.id for r in engine.filter(people.selectExpr("id", "concat(w, '') AS w0").withColumnRenamed("w0", "w"), text.replace("w ", "(w + '') ").replace("= w", "= (w + '')")).collect())
        assert short == whole, text
