"""The thirteen star-schema benchmark queries, as DataFrames and as SQL; constants bound to the values in the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import Dimension, star_join
from . import star

Test = Callable[[], Column]

#: How many values the filtered columns have, about; a test of some of them keeps their share of the rows.
VALUES = {"region": 5, "nation": 25, "city": 250, "mfgr": 5, "category": 25, "brand1": 1000, "year": 7, "yearmonthnum": 84, "yearmonth": 84}


def _dims(v: dict[str, DataFrame], carry: tuple[str, ...] = (), **filters: Test) -> list[Dimension]:
    """The dimensions that a query filters or carries columns of."""
    out = []
    for name, label, fact_key, key in (
        ("ssb_part", "part", "lo_partkey", "p_partkey"),
        ("ssb_supplier", "supplier", "lo_suppkey", "s_suppkey"),
        ("ssb_customer", "customer", "lo_custkey", "c_custkey"),
        ("ddate", "date", "lo_orderdate", "d_datekey"),
    ):
        columns = tuple(c for c in carry if c in v[name].columns)
        if label in filters or columns:
            test = filters.get(label)
            also = ("lo_year", "d_year") if label == "date" and "lo_year" in v["lineorder"].columns else None
            out.append(Dimension(v[name], fact_key, key, test() if test else None, columns, getattr(test, "share", 1.0), also))
    return out


def _sharing(test: Test, share: float) -> Test:
    test.share = share
    return test


def _flight1(date: Test, low: int, high: int, quantity: Test) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        v = star.at(spark, folder)
        lines = v["lineorder"].where(F.col("lo_discount").between(low, high) & quantity())
        return star_join(lines, *_dims(v, date=date)).agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue"))

    return run


def _grouped(keys: tuple[str, ...], measure: str, order: tuple[str, ...], **filters: Test) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        v = star.at(spark, folder)
        value = F.col("lo_revenue") if measure == "revenue" else F.col("lo_revenue") - F.col("lo_supplycost")
        total = star_join(v["lineorder"], *_dims(v, keys, **filters)).groupBy(*keys).agg(F.sum(value).alias(measure))
        return total.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in order])

    return run


def _in(column: str, *values: object) -> Test:
    test = lambda: F.col(column).isin(*values) if len(values) > 1 else F.col(column) == values[0]
    return _sharing(test, len(values) / VALUES[column[2:]])


def _between(column: str, low: object, high: object) -> Test:
    """Of codes and years, the last digits count the values."""
    values = int(str(high)[-2:]) - int(str(low)[-2:]) + 1
    return _sharing(lambda: F.col(column).between(low, high), values % 100 / VALUES.get(column[2:], 50))


def _flight2(part: Test, region: str) -> Callable[[SparkSession, str], DataFrame]:
    keys = ("d_year", "p_brand1")
    return _grouped(keys, "revenue", keys, part=part, supplier=_in("s_region", region))


def _flight3(by: str, date: Test, *places: str) -> Callable[[SparkSession, str], DataFrame]:
    level = "region" if by == "nation" else "nation" if len(places) == 1 else "city"
    return _grouped((f"c_{by}", f"s_{by}", "d_year"), "revenue", ("d_year", "-revenue"), date=date, customer=_in(f"c_{level}", *places), supplier=_in(f"s_{level}", *places))


def _flight4(*keys: str, **filters: Test) -> Callable[[SparkSession, str], DataFrame]:
    return _grouped(keys, "profit", keys, customer=_in("c_region", "AMERICA"), **filters)


_LATER = _between("d_year", 1996, 2000)
_TWO_YEARS = _in("d_year", 1997, 1998)
_TWO_MAKERS = _in("p_mfgr", "MFGR#1", "MFGR#2")
_TWO_CITIES = ("NATION_2-1", "NATION_2-5")
_HOME = _in("s_region", "AMERICA")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ssb_q1_1": _flight1(_in("d_year", 1996), 1, 3, lambda: F.col("lo_quantity") < 25),
    "ssb_q1_2": _flight1(_in("d_yearmonthnum", 199701), 4, 6, _between("lo_quantity", 26, 35)),
    "ssb_q1_3": _flight1(_sharing(lambda: (F.col("d_weeknuminyear") == 6) & (F.col("d_year") == 1997), 1 / 364), 5, 7, _between("lo_quantity", 26, 35)),
    "ssb_q2_1": _flight2(_in("p_category", "MFGR#12"), "AMERICA"),
    "ssb_q2_2": _flight2(_between("p_brand1", "MFGR#2221", "MFGR#2228"), "ASIA"),
    "ssb_q2_3": _flight2(_in("p_brand1", "MFGR#2239"), "EUROPE"),
    "ssb_q3_1": _flight3("nation", _LATER, "ASIA"),
    "ssb_q3_2": _flight3("city", _LATER, "NATION_2"),
    "ssb_q3_3": _flight3("city", _LATER, *_TWO_CITIES),
    "ssb_q3_4": _flight3("city", _in("d_yearmonth", "Dec1997"), *_TWO_CITIES),
    "ssb_q4_1": _flight4("d_year", "c_nation", part=_TWO_MAKERS, supplier=_HOME),
    "ssb_q4_2": _flight4("d_year", "s_nation", "p_category", date=_TWO_YEARS, part=_TWO_MAKERS, supplier=_HOME),
    "ssb_q4_3": _flight4("d_year", "s_city", "p_brand1", date=_TWO_YEARS, part=_in("p_category", "MFGR#14"), supplier=_in("s_nation", "NATION_1")),
}

_KEYS = "lo_orderdate = d_datekey"
_P, _S, _C = "lo_partkey = p_partkey", "lo_suppkey = s_suppkey", "lo_custkey = c_custkey"


def _sql(select: str, tables: str, *tests: str, by: str = "", order: str = "") -> str:
    tail = f" GROUP BY {by}" if by else ""
    return f"SELECT {select} FROM lineorder, {tables} WHERE {' AND '.join(tests)}{tail}" + (f" ORDER BY {order}" if order else "")


def _sql1(*tests: str) -> str:
    return _sql("CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue", "ddate", _KEYS, *tests)


def _sql2(*tests: str) -> str:
    return _sql("CAST(sum(lo_revenue) AS BIGINT) AS revenue, d_year, p_brand1", "ddate, ssb_part, ssb_supplier", _KEYS, _P, _S, *tests, by="d_year, p_brand1", order="d_year, p_brand1")


def _sql3(by: str, *tests: str) -> str:
    keys = f"c_{by}, s_{by}, d_year"
    return _sql(f"{keys}, CAST(sum(lo_revenue) AS BIGINT) AS revenue", "ssb_customer, ssb_supplier, ddate", _C, _S, _KEYS, *tests, by=keys, order="d_year, revenue DESC")


def _sql4(keys: str, *tests: str) -> str:
    return _sql(f"{keys}, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit", "ddate, ssb_customer, ssb_supplier, ssb_part", _C, _S, _P, _KEYS, *tests, by=keys, order=keys)


_SQL_CITIES = "(c_city = 'NATION_2-1' OR c_city = 'NATION_2-5') AND (s_city = 'NATION_2-1' OR s_city = 'NATION_2-5')"
_SQL_LATER = "d_year >= 1996 AND d_year <= 2000"
_SQL_MAKERS = "(p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')"

#: The queries over the star views in SQL that both engines read.
SQL: dict[str, str] = {
    "ssb_q1_1": _sql1("d_year = 1996", "lo_discount >= 1", "lo_discount <= 3", "lo_quantity < 25"),
    "ssb_q1_2": _sql1("d_yearmonthnum = 199701", "lo_discount BETWEEN 4 AND 6", "lo_quantity BETWEEN 26 AND 35"),
    "ssb_q1_3": _sql1("d_weeknuminyear = 6", "d_year = 1997", "lo_discount BETWEEN 5 AND 7", "lo_quantity BETWEEN 26 AND 35"),
    "ssb_q2_1": _sql2("p_category = 'MFGR#12'", "s_region = 'AMERICA'"),
    "ssb_q2_2": _sql2("p_brand1 >= 'MFGR#2221'", "p_brand1 <= 'MFGR#2228'", "s_region = 'ASIA'"),
    "ssb_q2_3": _sql2("p_brand1 = 'MFGR#2239'", "s_region = 'EUROPE'"),
    "ssb_q3_1": _sql3("nation", "c_region = 'ASIA'", "s_region = 'ASIA'", _SQL_LATER),
    "ssb_q3_2": _sql3("city", "c_nation = 'NATION_2'", "s_nation = 'NATION_2'", _SQL_LATER),
    "ssb_q3_3": _sql3("city", _SQL_CITIES, _SQL_LATER),
    "ssb_q3_4": _sql3("city", _SQL_CITIES, "d_yearmonth = 'Dec1997'"),
    "ssb_q4_1": _sql4("d_year, c_nation", "c_region = 'AMERICA'", "s_region = 'AMERICA'", _SQL_MAKERS),
    "ssb_q4_2": _sql4("d_year, s_nation, p_category", "c_region = 'AMERICA'", "s_region = 'AMERICA'", "(d_year = 1997 OR d_year = 1998)", _SQL_MAKERS),
    "ssb_q4_3": _sql4("d_year, s_city, p_brand1", "c_region = 'AMERICA'", "s_nation = 'NATION_1'", "(d_year = 1997 OR d_year = 1998)", "p_category = 'MFGR#14'"),
}

ORACLES = {k: star.CTES + v for k, v in SQL.items()}
