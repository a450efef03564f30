"""The queries by name: each operator over the whole test tables, with the SQL that a second engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.grouping import global_aggregate, grouping_sets, having
from ..operators.quantified import compare_all, compare_any
from ..sources import delimited, schema, scratch
from . import ssb, star
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(ssb.QUERIES)
ORACLES: dict[str, str] = dict(ssb.ORACLES)
c, lit = F.col, F.lit


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return star.table(self.spark, self.folder, name)


def add(key: str, run: Callable[[Tables], DataFrame], oracle: str) -> None:
    QUERIES[key] = lambda spark, folder: run(Tables(spark, folder))
    ORACLES[key] = oracle


def add_sql(key: str, sql: str, oracle: str) -> None:
    """A query in the dialect, through the engine; the oracle is plain SQL."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return Engine(spark).register_folder(folder).sql(sql)

    QUERIES[key] = run
    ORACLES[key] = oracle


# --- sources, sinks ------------------------------------------------------------------------

SUPPLIER_TEXT = "SUPPLIER|S_SUPPKEY:INTEGER|S_NAME:TEXT:25|S_NATIONKEY:INTEGER|S_CENTS:INTEGER"


def _load_roundtrip(t: Tables) -> DataFrame:
    """Writes suppliers as delimited text, loads that by a declared schema into Parquet, and reads it."""
    struct = schema.parse(SUPPLIER_TEXT)["supplier"]
    path = scratch.new_path(t.spark, "load")
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey", star.cents(c("s_acctbal")).alias("s_cents"))
    delimited.write_text(rows, f"{path}/text", trailing=True)
    delimited.write_parquet(delimited.read_text(t.spark, f"{path}/text", struct), f"{path}/parquet")
    return t.spark.read.parquet(f"{path}/parquet")


def _cluster_by_key(t: Tables) -> DataFrame:
    """Writes line items clustered by supplier, and reads a key range, which Parquet statistics prune by."""
    path = scratch.new_path(t.spark, "clustered")
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", star.cents(c("l_extendedprice")).alias("price_cents"))
    delimited.write_parquet(delimited.cluster(rows, "l_suppkey"), path)
    return t.spark.read.parquet(path).where(c("l_suppkey").between(3, 7))


add("load_roundtrip", _load_roundtrip, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS s_cents FROM supplier")
add("cluster_by_key", _cluster_by_key, "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents FROM lineitem WHERE l_suppkey BETWEEN 3 AND 7")
add("scan_full", lambda t: t.orders, "SELECT * FROM orders")
add(
    "scan_filter_project",
    lambda t: t.lineitem.where((c("l_quantity") < 10) & (c("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_quantity"),
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'",
)

# --- projection ----------------------------------------------------------------------------

add("project_columns", lambda t: t.customer.select("c_custkey", "c_name", "c_mktsegment"), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
add("project_star", lambda t: t.part.select("*"), "SELECT * FROM part")
add(
    "project_qualified_star",
    lambda t: t.nation.alias("n").join(joins.small(t.region.alias("r")), c("n.n_regionkey") == c("r.r_regionkey")).select("n.*", "r.r_name"),
    "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
)
add("project_alias", lambda t: t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("label")), "SELECT s_suppkey AS id, s_name AS label FROM supplier")
add_sql("project_alias_implicit", "SELECT s_suppkey id, s_name label FROM supplier", "SELECT s_suppkey AS id, s_name AS label FROM supplier")
add("project_constant", lambda t: t.nation.select("n_name", lit(7).alias("seven"), lit("x").alias("mark")), "SELECT n_name, 7 AS seven, 'x' AS mark FROM nation")
add(
    "project_arithmetic",
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (star.cents(c("l_extendedprice")) * c("l_linenumber") - 5).alias("scaled")),
    "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * l_linenumber - 5 AS scaled FROM lineitem",
)

# --- filters -------------------------------------------------------------------------------

_LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
_ORDER = ("o_orderkey", "o_orderstatus", "o_totalprice")


def _filter(key: str, table: str, test, sql: str, *columns: str) -> None:
    add(key, lambda t: getattr(t, table).where(test()).select(*columns), f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")


_day = lambda: star.date_key(c("o_orderdate"))
_sql_day = "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER)"
_filter("filter_eq", "orders", lambda: c("o_orderpriority") == "1-URGENT", "o_orderpriority = '1-URGENT'", *_ORDER)
_filter("filter_gt", "orders", lambda: c("o_totalprice") > 400000, "o_totalprice > 400000", *_ORDER)
_filter("filter_lt", "orders", lambda: c("o_totalprice") < 20000, "o_totalprice < 20000", *_ORDER)
_filter("filter_ge", "lineitem", lambda: c("l_quantity") >= 49, "l_quantity >= 49", *_LINE)
_filter("filter_le", "lineitem", lambda: c("l_quantity") <= 2, "l_quantity <= 2", *_LINE)
_filter("filter_ne", "orders", lambda: c("o_orderstatus") != "O", "o_orderstatus <> 'O'", *_ORDER)
_filter("filter_and", "lineitem", lambda: (c("l_quantity") > 10) & (c("l_discount") < 0.05) & (c("l_linestatus") == "F"), "l_quantity > 10 AND l_discount < 0.05 AND l_linestatus = 'F'", *_LINE)
_filter("filter_or", "lineitem", lambda: (c("l_quantity") < 3) | (c("l_tax") > 0.07) | (c("l_returnflag") == "A"), "l_quantity < 3 OR l_tax > 0.07 OR l_returnflag = 'A'", *_LINE)
_filter(
    "filter_nested_bool", "lineitem",
    lambda: ((c("l_quantity") < 5) | ((c("l_discount") > 0.08) & (c("l_returnflag") == "N"))) & ((c("l_linestatus") == "O") | (c("l_linenumber") == 1)),
    "(l_quantity < 5 OR (l_discount > 0.08 AND l_returnflag = 'N')) AND (l_linestatus = 'O' OR l_linenumber = 1)", *_LINE,
)
_filter("filter_not", "orders", lambda: ~((c("o_orderstatus") == "F") | (c("o_totalprice") > 100000)), "NOT (o_orderstatus = 'F' OR o_totalprice > 100000)", *_ORDER)
_filter("filter_like", "part", lambda: c("p_type").like("%A%E%"), "p_type LIKE '%A%E%'", "p_partkey", "p_type")
_filter("filter_not_like", "part", lambda: ~c("p_name").like("%1_"), "p_name NOT LIKE '%1_'", "p_partkey", "p_name")
add_sql("filter_like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%!_1%' ESCAPE '!'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%!_1%' ESCAPE '!'")
add(
    "filter_is_null",
    lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").where(c("o_orderkey").isNull()).select("c_custkey", "c_name"),
    "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
)
add(
    "filter_is_not_null",
    lambda t: t.customer.join(t.orders.where(c("o_totalprice") > 300000), c("c_custkey") == c("o_custkey"), "left").where(c("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey"),
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL",
)
_nan = lambda: F.when(c("event_id") % 10 == 0, lit(float("nan"))).when(c("event_id") % 10 == 1, lit(float("inf"))).otherwise(c("value"))
add("filter_is_nan", lambda t: t.events.where(F.isnan(_nan())).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE isnan(CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 10 = 1 THEN 'inf'::DOUBLE ELSE value END)")
add("filter_is_infinite", lambda t: t.events.where(F.abs(_nan()) == float("inf")).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_id % 10 = 1")
_filter("filter_between", "lineitem", lambda: c("l_quantity").between(20, 22), "l_quantity BETWEEN 20 AND 22", *_LINE)
_filter("filter_not_between", "lineitem", lambda: ~c("l_quantity").between(3, 48), "l_quantity NOT BETWEEN 3 AND 48", *_LINE)
_filter("filter_in", "part", lambda: c("p_size").isin(1, 15, 23, 49), "p_size IN (1, 15, 23, 49)", "p_partkey", "p_size")
_filter("filter_not_in", "part", lambda: ~c("p_brand").isin("Brand#1", "Brand#2"), "p_brand NOT IN ('Brand#1', 'Brand#2')", "p_partkey", "p_brand")
_filter(
    "filter_tuple_in", "lineitem", lambda: ((c("l_returnflag") == "A") & (c("l_linestatus") == "F")) | ((c("l_returnflag") == "N") & (c("l_linestatus") == "O")),
    "(l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
)
add("filter_regexp", lambda t: t.customer.where(c("c_name").rlike("[13579]$")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[13579]$')")
_filter("filter_col_col", "lineitem", lambda: c("l_discount") < c("l_tax"), "l_discount < l_tax", "l_orderkey", "l_linenumber")
_filter("filter_const_left", "lineitem", lambda: lit(5) < c("l_linenumber"), "5 < l_linenumber", "l_orderkey", "l_linenumber")
add("filter_date_key", lambda t: t.orders.where((_day() >= 19970101) & (_day() < 19970401)).select("o_orderkey", _day().alias("day_key")), f"SELECT o_orderkey, {_sql_day} AS day_key FROM orders WHERE {_sql_day} >= 19970101 AND {_sql_day} < 19970401")
_filter("filter_text_range", "part", lambda: (c("p_brand") >= "Brand#12") & (c("p_brand") <= "Brand#19"), "p_brand >= 'Brand#12' AND p_brand <= 'Brand#19'", "p_partkey", "p_brand")

# --- subqueries ----------------------------------------------------------------------------

_big = "SELECT o_custkey FROM orders WHERE o_totalprice > 400000"
add(
    "semi_in_subquery",
    lambda t: t.customer.join(t.orders.where(c("o_totalprice") > 400000), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name"),
    f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_big})",
)
add_sql("anti_not_in", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({_big})", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({_big})")
add(
    "semi_exists",
    lambda t: t.part.join(t.lineitem.where(c("l_quantity") > 49), c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
)
add(
    "anti_not_exists",
    lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name"),
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
add(
    "scalar_subquery",
    lambda t: t.orders.join(F.broadcast(t.orders.agg(F.max("o_totalprice").alias("most"))), c("o_totalprice") * 2 > c("most")).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice * 2 > (SELECT max(o_totalprice) FROM orders)",
)
add(
    "scalar_subquery_corr",
    lambda t: t.orders.join(t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("most")), (c("o_custkey") == c("k")) & (c("o_totalprice") == c("most"))).select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders a WHERE o_totalprice = (SELECT max(b.o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)",
)
_top = "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)"
add_sql(
    "tuple_eq_subquery",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) = ({_top})",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) IN ({_top})",
)
_q = "SELECT p_size FROM part WHERE p_brand = 'Brand#3'"
add("quantified_any", lambda t: compare_any(t.part, c("p_size"), "<", t.part.where(c("p_brand") == "Brand#3").select(c("p_size").alias("v")), "v").select("p_partkey", "p_size"), f"SELECT p_partkey, p_size FROM part WHERE p_size < ANY ({_q})")
add("quantified_all", lambda t: compare_all(t.part, c("p_size"), ">=", t.part.where(c("p_brand") == "Brand#3").select(c("p_size").alias("v")), "v").select("p_partkey", "p_size"), f"SELECT p_partkey, p_size FROM part WHERE p_size >= ALL ({_q})")
add_sql("sql_any_subquery", f"SELECT p_partkey FROM part WHERE p_size < ANY ({_q})", f"SELECT p_partkey FROM part WHERE p_size < ANY ({_q})")
add_sql("sql_all_subquery", f"SELECT p_partkey FROM part WHERE p_size > ALL ({_q} AND p_size < 40)", f"SELECT p_partkey FROM part WHERE p_size > ALL ({_q} AND p_size < 40)")
add_sql("sql_all_empty", "SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_size < 0)", "SELECT p_partkey FROM part")
add_sql("sql_not_all", f"SELECT p_partkey FROM part WHERE p_size <> ALL ({_q})", f"SELECT p_partkey FROM part WHERE p_size NOT IN ({_q})")
add_sql("sql_any_list", "SELECT p_partkey FROM part WHERE p_size = ANY (1, 2, 3) OR p_size > ALL (47, 48)", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) OR p_size > 48")
add(
    "subquery_from",
    lambda t: t.orders.groupBy("o_custkey").agg(F.count(lit(1)).alias("n")).where(c("n") > 12).select("o_custkey", "n"),
    "SELECT x.o_custkey, x.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE x.n > 12",
)
add_sql("subquery_select", "SELECT n_name, (SELECT max(r_name) FROM region) AS last_region FROM nation", "SELECT n_name, (SELECT max(r_name) FROM region) AS last_region FROM nation")
add("alias_table", lambda t: t.nation.alias("a").where(c("a.n_regionkey") == 1).select("a.n_name"), "SELECT a.n_name FROM nation a WHERE a.n_regionkey = 1")

# --- joins ---------------------------------------------------------------------------------

add("join_fk_hash", lambda t: joins.fk_join(t.lineitem, t.part.select("p_partkey", "p_brand"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_brand"), "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
add("join_shuffle_hash", lambda t: joins.shuffled_hash_join(t.lineitem, t.part.select("p_partkey", "p_brand"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_brand"), "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")


def _star(v: dict[str, DataFrame], join: Callable[..., DataFrame]) -> DataFrame:
    dims = (
        joins.Dimension(v["ssb_customer"], "lo_custkey", "c_custkey", c("c_region") == "ASIA", ("c_nation",), 1 / 5),
        joins.Dimension(v["ssb_supplier"], "lo_suppkey", "s_suppkey", c("s_region") == "EUROPE", ("s_nation",), 1 / 5),
        joins.Dimension(v["ddate"], "lo_orderdate", "d_datekey", c("d_year") == 1998, ("d_yearmonthnum",), 1 / 7),
    )
    return join(v["lineorder"], *dims).select("lo_orderkey", "lo_linenumber", "c_nation", "s_nation", "d_yearmonthnum", "lo_revenue")


_STAR_SQL = (
    star.CTES + "SELECT lo_orderkey, lo_linenumber, c_nation, s_nation, d_yearmonthnum, lo_revenue FROM lineorder, ssb_customer, ssb_supplier, ddate "
    "WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_orderdate = d_datekey AND c_region = 'ASIA' AND s_region = 'EUROPE' AND d_year = 1998"
)
add("join_star_multiway", lambda t: _star(star.at(t.spark, t.folder), joins.star_join), _STAR_SQL)
add("join_invisible_semi", lambda t: _star(star.at(t.spark, t.folder), joins.reduced_star_join), _STAR_SQL)
add("join_star_derived", lambda t: _star(star.views(t.spark, t.folder), joins.star_join), _STAR_SQL)
_implicit = "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2"
add_sql("join_implicit", _implicit, _implicit)
add("join_inner_on", lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "inner").select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
_late = "(SELECT * FROM orders WHERE o_totalprice > 350000)"
_rich = "(SELECT * FROM customer WHERE c_acctbal > 5000)"


def _outer(how: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t.customer.where(c("c_acctbal") > 5000).join(t.orders.where(c("o_totalprice") > 350000), c("c_custkey") == c("o_custkey"), how).select("c_custkey", "o_orderkey")


for _how in ("left", "right", "full"):
    add(f"join_{_how}", _outer(_how), f"SELECT c_custkey, o_orderkey FROM {_rich} {_how.upper()} JOIN {_late} ON c_custkey = o_custkey")
add("join_cross", lambda t: t.nation.crossJoin(joins.small(t.region)).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
_renamed = "(SELECT n_nationkey AS nationkey, n_name FROM nation)"
_suppliers = "(SELECT s_suppkey, s_nationkey AS nationkey FROM supplier)"
_natural = f"SELECT s_suppkey, nationkey, n_name FROM {_suppliers} a NATURAL JOIN {_renamed} b"
add_sql("join_natural", _natural, _natural)
add("join_using", lambda t: t.supplier.withColumnRenamed("s_nationkey", "nationkey").join(t.nation.withColumnRenamed("n_nationkey", "nationkey"), ["nationkey"]).select("s_suppkey", "nationkey", "n_name"), f"SELECT s_suppkey, nationkey, n_name FROM {_suppliers} a JOIN {_renamed} b USING (nationkey)")
add_sql(
    "join_oracle_outer",
    "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c, orders o, nation n WHERE c.c_custkey = o.o_custkey (+) AND o.o_totalprice (+) > 350000 AND c.c_nationkey = n.n_nationkey",
    "SELECT c_custkey, o_orderkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000",
)
_bands = "(SELECT p_size AS band, 1000 + 40 * p_size AS low, 1000 + 40 * p_size + 15 AS high FROM part GROUP BY p_size)"
add(
    "join_theta",
    lambda t: joins.band_join(t.part, t.part.select(c("p_size").alias("band")).distinct().select("band", (1000 + 40 * c("band")).alias("low"), (1000 + 40 * c("band") + 15).alias("high")), "p_retailprice", "low", "high").select("p_partkey", "band"),
    f"SELECT p_partkey, band FROM part JOIN {_bands} ON p_retailprice >= low AND p_retailprice < high",
)
add(
    "join_composite_key",
    lambda t: t.lineitem.alias("a").join(t.lineitem.where(c("l_quantity") > 48).alias("b"), (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") == c("b.l_linenumber"))).select(c("a.l_orderkey").alias("l_orderkey"), c("a.l_linenumber").alias("l_linenumber"), c("a.l_partkey").alias("part_a"), c("b.l_partkey").alias("part_b")),
    "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 48",
)
add(
    "join_self",
    lambda t: t.lineitem.alias("a").join(t.lineitem.alias("b"), (c("a.l_orderkey") == c("b.l_orderkey")) & (c("b.l_linenumber") == c("a.l_linenumber") + 1)).select(c("a.l_orderkey").alias("l_orderkey"), c("a.l_partkey").alias("first"), c("b.l_partkey").alias("second")),
    "SELECT a.l_orderkey, a.l_partkey AS first, b.l_partkey AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
)

# --- aggregation ---------------------------------------------------------------------------

_price = lambda: star.cents(c("l_extendedprice"))
_qty = lambda: F.round("l_quantity").cast("long")
_sql_price, _sql_qty = "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(round(l_quantity) AS BIGINT)"
_big_sum = lambda x, name: f"CAST(sum({x}) AS BIGINT) AS {name}"
add("agg_group_by", lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sum(_qty()).alias("qty"), F.count(lit(1)).alias("n")), f"SELECT l_suppkey, {_big_sum(_sql_qty, 'qty')}, count(*) AS n FROM lineitem GROUP BY l_suppkey")
add("agg_group_multi", lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum(_price()).alias("price")), f"SELECT l_returnflag, l_linestatus, l_linenumber, {_big_sum(_sql_price, 'price')} FROM lineitem GROUP BY ALL")
add("agg_global", lambda t: global_aggregate(t.lineitem, F.sum(_qty()).alias("qty"), F.count(lit(1)).alias("n")), f"SELECT {_big_sum(_sql_qty, 'qty')}, count(*) AS n FROM lineitem")
add("agg_global_empty", lambda t: global_aggregate(t.lineitem.where(c("l_quantity") < 0), F.sum(_qty()).alias("qty"), F.count(lit(1)).alias("n")), f"SELECT {_big_sum(_sql_qty, 'qty')}, count(*) AS n FROM lineitem WHERE l_quantity < 0")
add("agg_sum", lambda t: t.orders.groupBy("o_orderstatus").agg(F.sum(star.cents(c("o_totalprice"))).alias("total")), "SELECT o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
add("agg_avg", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(_qty()), 6).alias("avg_qty")), f"SELECT l_returnflag, round(avg({_sql_qty}), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag")
add("agg_count", lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n")), "SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
add("agg_count_star", lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
add("agg_min_max", lambda t: t.part.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_name").alias("first"), F.max("p_retailprice").alias("dear")), "SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, min(p_name) AS first, max(p_retailprice) AS dear FROM part GROUP BY p_brand")
add("agg_count_distinct", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")), "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
add("agg_sum_product", lambda t: t.lineitem.groupBy("l_linestatus").agg(F.sum(_price() * _qty()).alias("x")), f"SELECT l_linestatus, {_big_sum(f'{_sql_price} * {_sql_qty}', 'x')} FROM lineitem GROUP BY l_linestatus")
add("agg_sum_difference", lambda t: t.lineitem.groupBy("l_linestatus").agg(F.sum(_price() - _qty()).alias("x")), f"SELECT l_linestatus, {_big_sum(f'{_sql_price} - {_sql_qty}', 'x')} FROM lineitem GROUP BY l_linestatus")
add("agg_deep_expr", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.sum((_price() - _qty() * 3) * (c("l_linenumber") + 2) - _qty()).alias("x")), f"SELECT l_returnflag, {_big_sum(f'({_sql_price} - {_sql_qty} * 3) * (l_linenumber + 2) - {_sql_qty}', 'x')} FROM lineitem GROUP BY l_returnflag")
add("agg_ratio", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(_price()) / F.sum(_qty()), 4).alias("x")), f"SELECT l_returnflag, round(sum({_sql_price}) / sum({_sql_qty}), 4) AS x FROM lineitem GROUP BY l_returnflag")
add("agg_group_expr", lambda t: t.orders.groupBy((F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("q")).agg(F.count(lit(1)).alias("n")), "SELECT CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS q, count(*) AS n FROM orders GROUP BY 1")
add("having_agg", lambda t: having(t.lineitem, ["l_partkey"], [F.sum(_qty()).alias("qty")], c("qty") > 900), f"SELECT l_partkey, {_big_sum(_sql_qty, 'qty')} FROM lineitem GROUP BY l_partkey HAVING sum({_sql_qty}) > 900")
add("having_key", lambda t: having(t.lineitem, ["l_suppkey"], [F.count(lit(1)).alias("n")], c("l_suppkey") <= 5), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING l_suppkey <= 5")
add("agg_rollup", lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum(_qty()).alias("qty")), f"SELECT l_returnflag, l_linestatus, {_big_sum(_sql_qty, 'qty')} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("agg_cube", lambda t: t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum(_qty()).alias("qty")), f"SELECT l_returnflag, l_linestatus, {_big_sum(_sql_qty, 'qty')} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("agg_grouping_sets", lambda t: grouping_sets(t.lineitem, [["l_returnflag"], ["l_linestatus", "l_linenumber"], []], F.sum(_qty()).alias("qty")), f"SELECT l_returnflag, l_linestatus, l_linenumber, {_big_sum(_sql_qty, 'qty')} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())")

# --- order ---------------------------------------------------------------------------------

add("sort_single_asc", lambda t: t.customer.orderBy("c_custkey").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
add("sort_single_desc", lambda t: t.part.orderBy(F.desc("p_retailprice")).select("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC")
add("sort_two_keys_mixed", lambda t: t.part.orderBy(F.asc("p_brand"), F.desc("p_size")).select("p_partkey", "p_brand", "p_size"), "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC")
add("sort_three_keys", lambda t: t.lineitem.orderBy("l_returnflag", F.desc("l_linestatus"), "l_shipdate").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"), "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate FROM lineitem ORDER BY l_returnflag, l_linestatus DESC, l_shipdate")
add("sort_by_alias", lambda t: t.orders.groupBy("o_custkey").agg(F.count(lit(1)).alias("n")).orderBy("n", "o_custkey"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n, o_custkey")
add_sql("sort_by_agg_expr", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey")
add("sort_nulls_last", lambda t: t.customer.join(t.orders.where(c("o_totalprice") > 400000), c("c_custkey") == c("o_custkey"), "left").orderBy(c("o_orderkey").asc_nulls_last(), "c_custkey").select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey ORDER BY o_orderkey NULLS LAST, c_custkey")
add_sql(
    "rownum_limit",
    "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) x WHERE ROWNUM <= 20",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)

# --- expressions ---------------------------------------------------------------------------

_SIZE = "SELECT p_partkey, {} AS x FROM part"


def _expr(key: str, column, sql: str) -> None:
    add(key, lambda t: t.part.select("p_partkey", column().alias("x")), _SIZE.format(sql))


_expr("expr_plus", lambda: c("p_size") + c("p_partkey"), "p_size + p_partkey")
_expr("expr_minus", lambda: c("p_partkey") - c("p_size"), "p_partkey - p_size")
_expr("expr_multiply", lambda: c("p_partkey") * c("p_size"), "p_partkey * p_size")
_expr("expr_divide", lambda: F.round(c("p_partkey") / c("p_size"), 8), "round(p_partkey / p_size, 8)")
_expr("expr_paren", lambda: (c("p_partkey") + 1) * (c("p_size") - (c("p_partkey") - 2)), "(p_partkey + 1) * (p_size - (p_partkey - 2))")
_expr("expr_unary_minus", lambda: -c("p_size"), "-p_size")
_expr("expr_concat", lambda: F.concat("p_brand", lit("/"), "p_type"), "p_brand || '/' || p_type")
_expr("expr_power", lambda: F.pow(c("p_size"), lit(2)), "power(p_size, 2)")
_expr("expr_case_simple", lambda: F.when(c("p_size") == 1, "one").when(c("p_size") == 2, "two").otherwise("many"), "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END")
_expr("expr_case_searched", lambda: F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "middle"), "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END")
_expr("expr_cast", lambda: c("p_size").cast("string"), "CAST(p_size AS VARCHAR)")
_expr("expr_builtin_fn", lambda: F.concat(F.upper("p_name"), F.length("p_type").cast("string"), F.substring("p_brand", 1, 3)), "upper(p_name) || CAST(length(p_type) AS VARCHAR) || substr(p_brand, 1, 3)")
_expr("expr_bool_literal", lambda: lit(True) & (c("p_size") > 10), "TRUE AND p_size > 10")
add("expr_datediff", lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("days")), "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")

# --- the dialect ---------------------------------------------------------------------------

add_sql("sql_not_equal_signs", "SELECT o_orderkey FROM orders WHERE o_orderstatus ^= 'O' AND o_orderpriority != '1-URGENT';", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT'")
add_sql("sql_power", "SELECT p_partkey, p_size ** 2 AS x FROM part", "SELECT p_partkey, power(p_size, 2) AS x FROM part")
add_sql("sql_quoting", 'SELECT "n_name" AS "name", N\'it\'\'s\' AS said FROM "nation" -- a comment\n', "SELECT n_name AS name, 'it''s' AS said FROM nation")
add_sql("sql_casts", "SELECT p_partkey, CAST(p_size AS NUMBER(10, 2)) AS n, CAST(p_size AS VARCHAR2(10)) AS s FROM part", "SELECT p_partkey, CAST(p_size AS DECIMAL(10, 2)) AS n, CAST(p_size AS VARCHAR) AS s FROM part")
add_sql("sql_is_nan", "SELECT event_id FROM events WHERE value IS NOT NAN AND value IS NOT INFINITE", "SELECT event_id FROM events WHERE NOT isnan(value) AND NOT isinf(value)")
add_sql("sql_count_distinct", "SELECT COUNT_DISTINCT(l_partkey) AS n FROM lineitem", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
add_sql("sql_is_nan_expression", "SELECT event_id FROM events WHERE value + 1 IS NOT NAN AND NOT value * 2 IS INFINITE AND NULLIF(event_type, 'click') IS NOT NULL", "SELECT event_id FROM events WHERE NOT isnan(value + 1) AND NOT isinf(value * 2) AND event_type <> 'click'")
add_sql(
    "sql_is_nan_null",
    "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey > 50 THEN CAST('NaN' AS BINARY_DOUBLE) ELSE o_totalprice END AS v FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey WHERE v IS NOT NAN",
    "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 AND o_custkey <= 50",
)
add_sql("sql_time_zone", "SELECT event_id, CAST(ts AT TIME ZONE 'Asia/Tokyo' AS VARCHAR2(30)) AS at FROM events", "SELECT event_id, rtrim(rtrim(strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS at FROM events")
add_sql("sql_regexp_like", "SELECT c_custkey FROM customer WHERE REGEXP_LIKE(c_name, '[02468]$')", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[02468]$')")
add_sql("sql_interval_days", "SELECT l_orderkey, l_linenumber, l_partkey, EXTRACT(DAY FROM (l_shipdate - o_orderdate) DAY TO SECOND) AS days FROM lineitem, orders WHERE l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
add_sql("sql_interval_months", "SELECT o_orderkey, EXTRACT(YEAR FROM (DATE '2001-01-01' - o_orderdate) YEAR TO MONTH) AS years FROM orders", "SELECT o_orderkey, CAST(datesub('month', o_orderdate, TIMESTAMP '2001-01-01 00:00:00') // 12 AS INTEGER) AS years FROM orders")
add_sql("sql_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
_sorted = "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey"
add_sql("sql_rownum_count", f"SELECT COUNT(*) AS n, MIN(x.p_partkey) AS least FROM ({_sorted}) x WHERE ROWNUM <= 7 AND x.p_partkey > 3", "SELECT count(*) AS n, min(p_partkey) AS least FROM (SELECT p_partkey FROM part WHERE p_partkey > 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 7)")
add_sql("sql_rownum_before_order", f"SELECT x.p_partkey AS k FROM ({_sorted}) x WHERE 8 > ROWNUM ORDER BY x.p_partkey DESC", "SELECT p_partkey AS k FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7) ORDER BY k DESC")
add_sql("sql_rownum_column", "SELECT COUNT(*) AS n, SUM(r) AS total FROM (SELECT o_orderkey, ROWNUM r FROM orders WHERE o_totalprice > 100000) y", "SELECT count(*) AS n, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS total FROM orders WHERE o_totalprice > 100000")
add_sql("sql_rownum_none", "SELECT o_orderkey FROM orders WHERE ROWNUM > 1", "SELECT o_orderkey FROM orders WHERE FALSE")
add_sql("sql_not_in_nulls", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders) AND c_custkey > 0", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders) AND c_custkey > 0")
add_sql("sql_any_in_select", f"SELECT p_partkey, p_size <= SOME ({_q}) AS some, p_size = ALL ({_q}) AS every FROM part", f"SELECT p_partkey, p_size <= ANY ({_q}) AS some, p_size = ALL ({_q}) AS every FROM part")

# --- grammar rules through the engine: the same text is the oracle ------------------------

_SAME = {
    "having": "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 20 AND l_suppkey > 2",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linenumber NOT BETWEEN 2 AND 6",
    "in": "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_brand NOT IN ('Brand#1', 'Brand#2')",
    "like": "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%1_'",
    "joins": "SELECT s.s_name, n.n_name, r.r_name FROM supplier s INNER JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT OUTER JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > 1",
    "full_join": f"SELECT c_custkey, o_orderkey FROM {_rich} c FULL OUTER JOIN {_late} o ON c.c_custkey = o.o_custkey",
    "right_join": f"SELECT c_custkey, o_orderkey FROM {_rich} c RIGHT JOIN {_late} o ON c.c_custkey = o.o_custkey",
    "cross_join": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "using": f"SELECT s_suppkey, nationkey, n_name FROM {_suppliers} a JOIN {_renamed} b USING (nationkey)",
    "subquery_from": "SELECT x.o_custkey, x.n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) x WHERE x.n > 12",
    "exists": "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 2)",
    "scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice * 2 > (SELECT MAX(o_totalprice) FROM orders)",
    "case": "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS a, CASE WHEN p_size < 10 THEN 'small' END AS b FROM part",
    "order": "SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_returnflag DESC, n, l_linenumber",
    "arithmetic": "SELECT p_partkey, -p_size + 3 * (p_partkey - 2) AS x, p_brand || '/' || p_type AS y FROM part",
    "group_expression": "SELECT l_linenumber + 1 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber + 1",
    "comments": "SELECT /* all */ n_name -- names\nFROM nation /* of */ n WHERE n.n_regionkey IS NOT NULL",
}
for _key, _sql in _SAME.items():
    add_sql(f"sql_{_key}", _sql, _sql)

for _key, _sql in ssb.SQL.items():

    def _through_engine(spark: SparkSession, folder: str, sql: str = _sql) -> DataFrame:
        return Engine(spark).register_star(folder).sql(sql)

    QUERIES[f"sql_{_key}"] = _through_engine
    ORACLES[f"sql_{_key}"] = ssb.ORACLES[_key]
