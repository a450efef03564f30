"""The schema language, the loader and the catalog."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from astrolabe.plans.engine import Engine
from astrolabe.sources import delimited, schema
from astrolabe.sources.catalog import Catalog

TEXT = "Part|p_key:INTEGER|P_PRICE:DECIMAL|p_name:TEXT:10|p_day:DATE\nSIDE|S_KEY:INTEGER|\n"


def test_schema_reads_and_writes_back():
    tables = schema.parse(TEXT)
    assert list(tables) == ["part", "side"]
    assert [f.dataType for f in tables["part"]] == [T.LongType(), T.DecimalType(18, 2), T.StringType(), T.IntegerType()]
    assert tables["part"]["p_name"].metadata["len"] == 10
    assert schema.parse(schema.to_text(tables)) == tables


@pytest.mark.parametrize(
    "bad",
    ["PART", "PART|P_KEY", "PART|P_KEY:BOOLEAN", "PART|P_NAME:TEXT", "PART|P_KEY:INTEGER:4", "PART|:INTEGER", "P|A:INTEGER|a:INTEGER", "P|A:INTEGER\nP|A:INTEGER"],
)
def test_schema_errors(bad):
    with pytest.raises(schema.SchemaError):
        schema.parse(bad)


def _write(tmp_path, text):
    p = tmp_path / "rows.tbl"
    p.write_text(text)
    return str(p)


def test_trailing_delimiters_empty_fields_and_full_width(spark, tmp_path):
    struct = schema.parse(TEXT)["part"]
    path = _write(tmp_path, '1|1.50|abcdefghij|19970102|\n2|.5|"x|19970103\n3|||\n')
    assert [tuple(map(str, r)) for r in delimited.read_text(spark, path, struct).orderBy("p_key").collect()] == [
        ("1", "1.50", "abcdefghij", "19970102"), ("2", "0.50", '"x', "19970103"), ("3", "None", "None", "None"),
    ]
    zero = delimited.read_text(spark, path, struct, empty_as_zero=True).where("p_key = 3").first()
    assert (str(zero.p_price), zero.p_name, zero.p_day) == ("0.00", "", 0)


def test_bad_number_fails(spark, tmp_path):
    struct = schema.parse(TEXT)["part"]
    with pytest.raises(PySparkException):
        delimited.read_text(spark, _write(tmp_path, "x|1|a|1\n"), struct).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["1|1|a|1|9", "1|1|a", "1|1|a|1||", "|", "1|1|a|x"])
def test_lines_that_do_not_fit_fail(spark, tmp_path, line, ansi):
    struct = schema.parse(TEXT)["part"]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert delimited.read_text(spark, _write(tmp_path, "1|1|a|1\n\n2|2|b|2|\n"), struct).count() == 2
        with pytest.raises(PySparkException):
            delimited.read_text(spark, _write(tmp_path, f"1|1|a|1\n{line}\n"), struct).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_text_round_trip_and_clustering(spark, tmp_path):
    df = spark.createDataFrame([(k, f"n{k % 7}") for k in range(200)] + [(None, '"q" \\ é'), (7, None)], "k long, t string")
    delimited.write_text(df, str(tmp_path / "t"), ";", trailing=True)
    key = lambda r: (r.k is None, r.k or 0, r.t or "")
    assert sorted(delimited.read_text(spark, str(tmp_path / "t"), df.schema, ";").collect(), key=key) == sorted(df.collect(), key=key)
    clustered = delimited.cluster(df.dropna(), "k", partitions=4)
    parts = [[r.k for r in p] for p in clustered.rdd.glom().collect() if p]
    assert len(parts) == 4 and all(p == sorted(p) for p in parts)
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("value", ["a;b", "a\nb", "a\rb"])
def test_values_that_cannot_be_read_back_are_refused(spark, tmp_path, value):
    with pytest.raises(PySparkException):
        delimited.write_text(spark.createDataFrame([(1, value)], "k long, t string"), str(tmp_path / "t"), ";")


def test_catalog_life(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    Engine(spark).register_star("/root/testdata/sf0.001")  # views of the session are no tables of a database
    spark.range(3).createOrReplaceTempView("part")
    catalog.create("shop", TEXT)
    try:
        assert catalog.list("shop") == ["part", "side"]
        assert spark.table("shop.part").count() == 0
        loaded = catalog.load("shop", "PART", _write(tmp_path, "2|1|b|19970101\n1|2|a|19970101\n"), cluster_by=("p_key",))
        assert [r.p_key for r in loaded.orderBy("p_key").collect()] == [1, 2]
        assert [tuple(r) for r in Engine(spark).sql("SELECT p.p_key, p.p_name FROM shop.part p WHERE p.p_key ^= 1").collect()] == [(2, "b")]
        spark.sql("DROP DATABASE shop CASCADE")
        assert catalog.restore("shop") == ["part", "side"]
        assert spark.table("shop.part").count() == 2
        catalog.delete("shop")
        assert spark.table("part").count() == 3
    finally:
        catalog.delete("shop")
        spark.catalog.dropTempView("part")
    assert not spark.catalog.databaseExists("shop") and not (tmp_path / "shop").exists()
    with pytest.raises(ValueError):
        catalog.create("../x", TEXT)
