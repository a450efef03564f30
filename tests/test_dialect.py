"""The dialect's rewrites, as text and by their results."""

import pytest

from astrolabe.plans.dialect import translate
from astrolabe.plans.engine import Engine


@pytest.mark.parametrize(
    ("source", "target"),
    [
        ("SELECT a FROM t WHERE a ^= 1;", "SELECT a FROM t WHERE a <> 1"),
        ("SELECT '^= \"x\" ** --' FROM t", "SELECT '^= \"x\" ** --' FROM t"),
        ('SELECT "A b" FROM "T"', "SELECT `A b` FROM `T`"),
        ("SELECT N'it''s' FROM t", "SELECT 'it''s' FROM t"),
        ("SELECT a ** b ** 2 FROM t", "SELECT power(a, power(b, 2)) FROM t"),
        ("SELECT (a + 1) ** f(b, 2) FROM t", "SELECT power((a + 1), f(b, 2)) FROM t"),
        ("SELECT CAST(a AS NUMBER(8,2)), CAST(b AS VARCHAR2(9)) FROM t", "SELECT CAST(a AS DECIMAL(8, 2)), CAST(b AS STRING) FROM t"),
        ("SELECT a FROM t WHERE x IS NOT NAN", "SELECT a FROM t WHERE ((x) IS NOT NULL AND NOT isnan(x))"),
        ("SELECT a FROM t WHERE a = SOME (SELECT b FROM u)", "SELECT a FROM t WHERE a IN (SELECT b FROM u)"),
        ("SELECT a FROM t WHERE a + 1 IS NAN OR b = 2", "SELECT a FROM t WHERE ((a + 1) IS NOT NULL AND isnan(a + 1)) OR b = 2"),
        ("SELECT a FROM t WHERE a = 1 OR a <> ALL (SELECT b FROM u)", "SELECT a FROM t WHERE a = 1 OR a NOT IN (SELECT b FROM u)"),
        ("SELECT a FROM t x WHERE ROWNUM <= 2 ORDER BY x.a", "SELECT a FROM (SELECT * FROM t x LIMIT 2) AS x ORDER BY x.a"),
        ("SELECT a FROM t WHERE 3 > ROWNUM AND ROWNUM >= 1", "SELECT a FROM t LIMIT 2"),
        ("SELECT x AT TIME ZONE 'A' FROM t", "SELECT convert_timezone(current_timezone(), 'A', x) FROM t"),
        ("SELECT a FROM t WHERE a > ANY (1, 2)", "SELECT a FROM t WHERE (a > 1 OR a > 2)"),
        ("SELECT a FROM t WHERE (a, b) = (SELECT c, d FROM u)", "SELECT a FROM t WHERE (a, b) IN (SELECT c, d FROM u)"),
        ("SELECT x.a FROM t x, u WHERE x.k = u.k (+) AND x.a > 1", "SELECT x.a FROM t x LEFT JOIN u ON x.k = u.k WHERE x.a > 1"),
        ("SELECT a FROM (SELECT a FROM t ORDER BY a) WHERE ROWNUM < 5", "SELECT a FROM (SELECT a FROM t ORDER BY a) LIMIT 4"),
        ("SELECT (a - b) DAY TO SECOND FROM t", "SELECT (a - b) FROM t"),
        ("SELECT COUNT_DISTINCT(a) /* n */ FROM t", "SELECT COUNT(DISTINCT a) FROM t"),
        ("SELECT SYSDATE FROM t", "SELECT localtimestamp() FROM t"),
        ("SELECT SYSDATE - 2 FROM t", "SELECT (localtimestamp() - make_dt_interval(2)) FROM t"),
    ],
)
def test_text(source, target):
    assert translate(source) == target


def test_joins_marked_in_a_chain():
    sql = "SELECT a.x FROM a, b, c WHERE a.k = b.k (+) AND b.j = c.j (+) AND a.x BETWEEN 1 AND 2"
    assert translate(sql) == "SELECT a.x FROM a LEFT JOIN b ON a.k = b.k LEFT JOIN c ON b.j = c.j WHERE a.x BETWEEN 1 AND 2"
    with pytest.raises(ValueError):
        translate("SELECT 1 FROM a, b WHERE a.k (+) = b.k (+)")


@pytest.fixture
def engine(spark):
    t = spark.createDataFrame([(1, 10, 1.0), (2, 20, float("nan")), (3, None, float("inf"))], "k int, v int, x double")
    u = spark.createDataFrame([(10,), (None,)], "v int")
    none = spark.createDataFrame([], "v int")
    return Engine(spark).register({"t": t, "u": u, "none": none})


def keys(engine, sql):
    return sorted(r[0] for r in engine.sql(sql).collect())


def test_nulls_and_empty_sets_in_quantified_comparisons(engine):
    assert keys(engine, "SELECT k FROM t WHERE v > ALL (SELECT v FROM none)") == [1, 2, 3]
    assert keys(engine, "SELECT k FROM t WHERE v > ANY (SELECT v FROM none)") == []
    assert keys(engine, "SELECT k FROM t WHERE v >= ALL (SELECT v FROM u)") == []  # one value is unknown
    assert keys(engine, "SELECT k FROM t WHERE v >= ANY (SELECT v FROM u)") == [1, 2]
    assert keys(engine, "SELECT k FROM t WHERE v <> ALL (SELECT v FROM u WHERE v IS NOT NULL)") == [2]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.x FROM a, b WHERE a.x = b.x (+) AND b.x (+) = 3 OR a.x = 9", "SELECT a.x FROM a, b WHERE a.x = b.x (+) AND (b.x (+) = 3 OR a.x = 9)",
        "SELECT x FROM a WHERE ROWNUM < 3 OR x = 1", "SELECT x FROM a WHERE (ROWNUM < 3 OR x = 1) AND x > 0", "SELECT a.*, ROWNUM FROM a", "SELECT *, ROWNUM FROM a",
        "SELECT (a) YEAR TO MONTH FROM t",
    ],
)
def test_what_would_mean_something_else_is_refused(sql):
    with pytest.raises(ValueError):
        translate(sql)


def test_rownum_comes_before_grouping_and_sorting(engine):
    top = "(SELECT k, v FROM t ORDER BY k)"
    assert keys(engine, f"SELECT k FROM {top} WHERE ROWNUM <= 2 ORDER BY k DESC") == [1, 2]
    assert keys(engine, "SELECT COUNT(*) FROM t WHERE ROWNUM <= 2") == [2]
    assert keys(engine, "SELECT COUNT(*) FROM t WHERE ROWNUM > 1") == [0] and keys(engine, "SELECT k FROM t WHERE ROWNUM >= 1") == [1, 2, 3]
    run = engine.execute("SELECT a.k, ROWNUM, b.k AS other FROM t a, t b WHERE a.k = b.k AND ROWNUM < 3 ORDER BY a.k")
    assert run.columns == ["k", "ROWNUM", "other"] and sorted(r[1] for r in run.rows) == [1, 2] and all(r[0] == r[2] for r in run.rows)
    assert len(engine.sql("SELECT DISTINCT 1 AS one FROM t WHERE ROWNUM <= 2").collect()) == 1


@pytest.mark.parametrize("word", ["ANY", "ALL"])
@pytest.mark.parametrize("sign", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("held", [[], [2], [1, 3], [2, None], [None], [3, 3]])
def test_truth_of_quantified_comparisons(spark, word, sign, held):
    left = [1, 2, 3, None]
    e = Engine(spark).register({"l": spark.createDataFrame([(k, v) for k, v in enumerate(left)], "k int, x int"), "r": spark.createDataFrame([(v,) for v in held], "v int")})
    test = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[sign]

    def truth(x):
        each = [None if x is None or v is None else getattr(x, test)(v) for v in held]
        decided = word == "ANY"
        return decided if decided in each else None if None in each else not decided

    assert [r[0] for r in e.sql(f"SELECT x {sign} {word} (SELECT v FROM r) AS t FROM l ORDER BY k").collect()] == [truth(x) for x in left]
    plan = e.sql(f"SELECT k FROM l WHERE x {sign} {word} (SELECT v FROM r)")
    assert [r.k for r in plan.orderBy("k").collect()] == [k for k, x in enumerate(left) if truth(x) is True]
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_not_in_is_a_plain_anti_join(engine):
    sql = "SELECT k FROM t WHERE v NOT IN (SELECT v FROM {}) AND k > 0"
    assert keys(engine, sql.format("u")) == [] and keys(engine, sql.format("none")) == [1, 2, 3]
    assert keys(engine, sql.format("(SELECT v FROM u WHERE v IS NOT NULL)")) == [2]
    plan = engine.sql(sql.format("u"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "true" not in plan.split("LeftAnti")[1].split("\n")[0]


def test_zones_outside_utc(spark, engine):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        one = lambda sql: str(engine.sql(f"SELECT {sql} AS x FROM t WHERE k = 1").first()[0])
        noon = "TIMESTAMP_NTZ '2021-01-05 12:00:00'"
        assert one(f"{noon} AT TIME ZONE 'Asia/Tokyo'") == "2021-01-06 02:00:00"
        assert one(f"({noon} AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC'") == "2021-01-05 17:00:00"
        assert one(f"CAST({noon} AS TIMESTAMP) AT TIME ZONE 'UTC'") == "2021-01-05 17:00:00" and one(f"{noon} AT LOCAL") == "2021-01-05 12:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_differences_as_intervals(engine):
    days = "SELECT EXTRACT(DAY FROM (TIMESTAMP '2021-03-01 06:00:00' - TIMESTAMP '2021-02-27 07:00:00') DAY TO SECOND) FROM t WHERE k = 1"
    months = "SELECT EXTRACT(MONTH FROM (DATE '2021-03-05' - DATE '2019-01-10') YEAR TO MONTH) FROM t WHERE k = 1"
    assert keys(engine, days) == [1] and keys(engine, months) == [1]
    assert keys(engine, "SELECT SYSDATE - 1 < SYSDATE FROM t WHERE k = 1") == [True]


def test_special_values(engine):
    assert keys(engine, "SELECT k FROM t WHERE x IS NAN") == [2]
    assert keys(engine, "SELECT k FROM t WHERE x IS INFINITE") == [3]
    assert keys(engine, "SELECT k FROM t WHERE x IS NOT NAN AND x IS NOT INFINITE") == [1]
    assert keys(engine, "SELECT k FROM t WHERE v + 1 IS NOT NAN") == [1, 2] == keys(engine, "SELECT k FROM t WHERE v * 2.0 IS NOT INFINITE")
    assert keys(engine, "SELECT k FROM t WHERE NOT x + 1 IS NAN AND k < 3") == [1]


def test_engine_runs_and_explains(engine):
    run = engine.execute("SELECT k, v FROM t WHERE k ^= 2 ORDER BY k;")
    assert run.columns == ["k", "v"] and [tuple(r) for r in run.rows] == [(1, 10), (3, None)]
    assert "Filter" in engine.explain("SELECT k FROM t WHERE k > 1")
