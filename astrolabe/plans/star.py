"""A star schema over the TPC-H-like tables: lineorder and the dimensions customer, supplier, part and date.

Measures are integers (cents, whole quantities, percents), so sums are exact in any order. The same derivations
exist as DataFrames (`views`) and as SQL common table expressions (`CTES`). Queries read the views as stored once
(`at`): facts by year and sorted by date, dimensions as small files whose size is known to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..sources import scratch

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def _place(df: DataFrame, nation: DataFrame, region: DataFrame, prefix: str, key: str) -> DataFrame:
    """Adds nation, region and city."""
    named = df.join(small(nation), df[f"{prefix}_nationkey"] == nation.n_nationkey).join(small(region), nation.n_regionkey == region.r_regionkey)
    return named.withColumn(f"{prefix}_nation", F.col("n_name")).withColumn(f"{prefix}_region", F.col("r_name")).withColumn(f"{prefix}_city", F.concat("n_name", F.lit("-"), (F.col(key) % 10).cast("string")))


def customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return _place(customer, nation, region, "c", "c_custkey").select("c_custkey", "c_name", "c_city", "c_nation", "c_region", "c_mktsegment")


def suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return _place(supplier, nation, region, "s", "s_suppkey").select("s_suppkey", "s_name", "s_city", "s_nation", "s_region")


def parts(part: DataFrame) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") - 1
    mfgr = F.concat(F.lit("MFGR#"), F.floor(number / 5 + 1).cast("string"))
    category = F.concat(mfgr, (number % 5 + 1).cast("string"))
    brand = F.concat(category, F.lpad(((F.col("p_partkey") % 40) + 1).cast("string"), 2, "0"))
    return part.select("p_partkey", "p_name", mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"), "p_type", "p_size")


def dates(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate")
    # distinct days first, the rest follows from the day
    return orders.select(F.col("o_orderdate").cast("date").alias("o_orderdate")).distinct().select(
        date_key(day).alias("d_datekey"),
        F.year(day).alias("d_year"),
        (F.year(day) * 100 + F.month(day)).alias("d_yearmonthnum"),
        F.date_format(day, "MMMyyyy").alias("d_yearmonth"),
        (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int").alias("d_weeknuminyear"),
    )


def line_orders(lineitem: DataFrame, orders: DataFrame, part: DataFrame | None) -> DataFrame:
    """The fact table. Lines meet their orders on the order key of both; parts add the supply cost. Without parts
    that column is left out, and its join with it: every line has a part, so no row depends on that join."""
    price, discount = cents(F.col("l_extendedprice")), F.round(F.col("l_discount") * 100).cast("int")
    lines = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    cost = []
    if part is not None:
        lines = lines.join(part.select(F.col("p_partkey").alias("lo_part"), "p_retailprice"), F.col("l_partkey") == F.col("lo_part"))
        cost = [F.floor(F.lit(6) * F.round(F.col("p_retailprice") * 100).cast("long") / 10).alias("lo_supplycost")]
    return (
        lines.select(
            F.col("l_orderkey").alias("lo_orderkey"),
            F.col("l_linenumber").alias("lo_linenumber"),
            F.col("o_custkey").alias("lo_custkey"),
            F.col("l_partkey").alias("lo_partkey"),
            F.col("l_suppkey").alias("lo_suppkey"),
            date_key(F.col("o_orderdate")).alias("lo_orderdate"),
            F.round("l_quantity").cast("int").alias("lo_quantity"),
            price.alias("lo_extendedprice"),
            cents(F.col("o_totalprice")).alias("lo_ordtotalprice"),
            discount.alias("lo_discount"),
            F.floor(price * (100 - discount) / 100).alias("lo_revenue"),
            *cost,
            F.round(F.col("l_tax") * 100).cast("int").alias("lo_tax"),
        )
    )


def views(spark: SparkSession, folder: str, cost: bool = True) -> dict[str, DataFrame]:
    """The five views; without cost, lineorder has no lo_supplycost."""
    t = {n: table(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    return {
        "lineorder": line_orders(t["lineitem"], t["orders"], t["part"] if cost else None),
        "ssb_customer": customers(t["customer"], t["nation"], t["region"]),
        "ssb_supplier": suppliers(t["supplier"], t["nation"], t["region"]),
        "ssb_part": parts(t["part"]),
        "ddate": dates(t["orders"]),
    }


#: A file of the stored facts, and the task that sorts and writes it, holds about so many lines, of one year.
FILE_LINES = 2_000_000
#: Buckets of orders that show whether one order is large.
BUCKETS = 1024
#: Stands for the year of lines without a date.
NO_YEAR = -(1 << 31)
NAMES = ("lineorder", "ssb_customer", "ssb_supplier", "ssb_part", "ddate")


def _year(day: Column) -> Column:
    return F.floor(day / 10000).cast("int")


def _counts(lineitem: DataFrame, orders: DataFrame) -> dict[int | None, tuple[int, int]]:
    """For each year its lines, and about the most that one order has: what its bucket has beyond a mean one."""
    year, bucket = _year(date_key(F.col("o_orderdate"))).alias("year"), F.pmod(F.xxhash64("l_orderkey"), F.lit(BUCKETS)).alias("bucket")
    # by buckets, since groups by order would be held for each order of a task
    each = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).groupBy(year, bucket).agg(F.count("*").alias("n"))
    years = each.groupBy("year").agg(F.sum("n").alias("lines"), F.max("n").alias("most"))
    return {r["year"]: (r["lines"], r["most"] - r["lines"] // BUCKETS) for r in years.collect()}


def _by_year(lines: DataFrame, counts: dict[int | None, tuple[int, int]]) -> DataFrame:
    """Deals lines out to tasks of their own year, as many as its count asks for, however the years differ in size. (By a hash of
    keys two years may come to one task, whatever the number of tasks.)"""
    at, own, large = 0, [], False
    for year, (n, most) in counts.items():
        parts = -(-n // FILE_LINES)
        own += [F.lit(NO_YEAR if year is None else year), F.struct(F.lit(at).alias("at"), F.lit(parts).alias("parts"))]
        at, large = at + parts, large or most > FILE_LINES // 8
    if not own:
        return lines.coalesce(1)
    mine = F.element_at(F.create_map(*own), F.coalesce("lo_year", F.lit(NO_YEAR)))
    # an order's lines stay together, as they compress better so, unless one order has a task's worth of them
    spread = F.xxhash64("lo_orderkey", *(("lo_linenumber", "lo_partkey", "lo_suppkey") if large else ()))
    return lines.repartitionById(at, (mine["at"] + F.pmod(spread, mine["parts"])).cast("int"))


def write(spark: SparkSession, folder: str, out: str) -> None:
    """Stores the views once, for many queries: facts partitioned by year and sorted by date, so that date ranges
    prune files and row groups and no query joins lines with orders again."""
    counts = _counts(table(spark, folder, "lineitem"), table(spark, folder, "orders"))
    for name, df in views(spark, folder).items():
        if name == "lineorder":
            df = _by_year(df.withColumn("lo_year", _year(F.col("lo_orderdate"))), counts).sortWithinPartitions("lo_year", "lo_orderdate")
            # without lines no year would have a file to tell the columns
            df.write.mode("overwrite").partitionBy(*(["lo_year"] if counts else [])).parquet(f"{out}/{name}.parquet")
        else:
            (df.coalesce(1) if name == "ddate" else df).write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def stored(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The views that write() stored."""
    return {n: table(spark, out, n) for n in NAMES}


_STORED: dict[tuple[str, str], str] = {}


def at(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The views of a folder, stored in the shared folder when first asked for."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch.new_path(spark, "star")
        write(spark, folder, path)
        _STORED[key] = path
    return stored(spark, _STORED[key])


#: The same views for the SQL oracle.
CTES = """
WITH lineorder AS (
    SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
           CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS lo_orderdate,
           CAST(round(l_quantity) AS INTEGER) AS lo_quantity,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice,
           CAST(round(o_totalprice * 100) AS BIGINT) AS lo_ordtotalprice,
           CAST(round(l_discount * 100) AS INTEGER) AS lo_discount,
           CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS INTEGER)) // 100 AS lo_revenue,
           6 * CAST(round(p_retailprice * 100) AS BIGINT) // 10 AS lo_supplycost,
           CAST(round(l_tax * 100) AS INTEGER) AS lo_tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), ssb_customer AS (
    SELECT c_custkey, c_name, n_name || '-' || CAST(c_custkey % 10 AS VARCHAR) AS c_city, n_name AS c_nation, r_name AS c_region, c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), ssb_supplier AS (
    SELECT s_suppkey, s_name, n_name || '-' || CAST(s_suppkey % 10 AS VARCHAR) AS s_city, n_name AS s_nation, r_name AS s_region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), numbered AS (
    SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) - 1 AS b FROM part
), ssb_part AS (
    SELECT p_partkey, p_name, 'MFGR#' || CAST(b // 5 + 1 AS VARCHAR) AS p_mfgr,
           'MFGR#' || CAST(b // 5 + 1 AS VARCHAR) || CAST(b % 5 + 1 AS VARCHAR) AS p_category,
           'MFGR#' || CAST(b // 5 + 1 AS VARCHAR) || CAST(b % 5 + 1 AS VARCHAR) || lpad(CAST(p_partkey % 40 + 1 AS VARCHAR), 2, '0') AS p_brand1, p_type, p_size
    FROM numbered
), ddate AS (
    SELECT DISTINCT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS d_datekey,
           CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS d_yearmonthnum,
           strftime(o_orderdate, '%b%Y') AS d_yearmonth, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS d_weeknuminyear
    FROM orders
)
"""
