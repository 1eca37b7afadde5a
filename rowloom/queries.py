"""Registered queries: one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.jsontext import json_canonical
from .operators import access as A
from .operators import changes as C
from .operators import expiry as X
from .operators.access import Interval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


c = F.col


def total(column: str | Column, name: str, digits: int = 2) -> Column:
    """A sum of doubles, rounded since the order of summing differs."""
    return F.round(F.sum(column), digits).alias(name)


# --- scans and predicates ------------------------------------------------------------------------------------------

query("full_scan", "SELECT * FROM customer")(lambda t: A.full_scan(t.customer))
query("point_get", "SELECT * FROM orders WHERE o_orderkey = 42")(lambda t: A.point_get(t.orders, "o_orderkey", [42]))
query("point_get_in_sorted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (17, 3, 29, 8, 25, 1, 12, 3)")(
    lambda t: A.point_get(t.orders, "o_orderkey", [17, 3, 29, 8, 25, 1, 12, 3], ["o_totalprice"])
)
query("point_get_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 7, -404)")(
    lambda t: A.point_get(t.orders, "o_orderkey", [3, 7, -404], [])
)
query("eq_lookup", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda t: A.equality(t.customer, "c_mktsegment", ["BUILDING"]))
query("eq_in_dedup", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'BUILDING')")(
    lambda t: A.equality(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY", "BUILDING"], ["c_custkey", "c_mktsegment"])
)


def _ranged(*intervals: Interval, descending: bool = False) -> Callable[[Tables], DataFrame]:
    return lambda t: A.ranges(t.orders, "o_totalprice", intervals, descending, ["o_orderkey", "o_totalprice"], ["o_orderkey"])


_RANGE = "SELECT o_orderkey, o_totalprice FROM orders WHERE "
query("range_closed", _RANGE + "o_totalprice BETWEEN 100000 AND 150000")(_ranged(Interval(100000, 150000)))
query("range_open", _RANGE + "o_totalprice > 100000 AND o_totalprice < 150000")(_ranged(Interval(100000, 150000, True, True)))
query("range_half_open", _RANGE + "o_totalprice >= 100000 AND o_totalprice < 150000")(_ranged(Interval(100000, 150000, False, True)))
query("range_one_sided", _RANGE + "o_totalprice > 250000")(_ranged(Interval(250000, low_open=True), descending=True))
query("range_or_overlap", _RANGE + "o_totalprice BETWEEN 100000 AND 150000 OR o_totalprice BETWEEN 140000 AND 160000 OR o_totalprice < 20000")(
    _ranged(Interval(100000, 150000), Interval(140000, 160000), Interval(None, 20000, high_open=True))
)
query("range_timestamp", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")(
    lambda t: t.events.where((c("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-05'")) & (c("ts") < F.expr("TIMESTAMP_NTZ '2024-01-06'"))).select("event_id", "ts")
)
query("string_range", "SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")(
    lambda t: A.ranges(t.customer, "c_name", [Interval("Customer#000000100", "Customer#000000200", False, True)], columns=["c_custkey", "c_name"])
)
query("non_key_range_on_pk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200")(
    lambda t: A.ranges(t.orders, "o_orderkey", [Interval(100, 200, True)], columns=["o_orderkey", "o_custkey"])
)
query("prefix_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'")(lambda t: t.part.where(c("p_type").like("S%")).select("p_partkey", "p_type"))
query("prefix_like_ordered", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1-%' ORDER BY o_orderpriority, o_orderkey")(
    lambda t: A.prefix(t.orders, "o_orderpriority", A.constant_prefix("1-%"), "o_orderkey", ["o_orderkey", "o_orderpriority"])
)
query("like_infix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%an%' AND p_name NOT LIKE '_a%'")(
    lambda t: t.part.where(c("p_name").like("%an%") & ~c("p_name").like("_a%")).select("p_partkey", "p_name")
)
query("residual_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority LIKE '%URGENT'")(
    lambda t: A.equality(t.orders, "o_orderstatus", ["F"]).where((c("o_totalprice") > 200000) & c("o_orderpriority").like("%URGENT")).select("o_orderkey")
)
query("covering_projection", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = 'O'")(
    lambda t: A.ranges(t.orders, "o_totalprice", [Interval(200000)]).where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderstatus")
)
query("projection_case_insensitive", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t: A.project(t.orders, ["O_TotalPrice", "o_ORDERKEY"]))
query("zero_width_count", "SELECT count(*) AS n FROM lineitem")(lambda t: A.row_count(t.lineitem))

_HOLED = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)"


def _holed(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))


query("is_null", f"SELECT c_custkey FROM {_HOLED} WHERE seg IS NULL")(lambda t: _holed(t).where(c("seg").isNull()).select("c_custkey"))
query("is_not_null", f"SELECT c_custkey, seg FROM {_HOLED} WHERE seg IS NOT NULL")(lambda t: _holed(t).where(c("seg").isNotNull()))
query("null_never_compares", f"SELECT c_custkey, seg FROM {_HOLED} WHERE seg <> 'MACHINERY'")(lambda t: _holed(t).where(c("seg") != "MACHINERY"))

# --- order, top-k, pages ---------------------------------------------------------------------------------------------

_TOP = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice {0}, o_orderkey LIMIT {1}"
query("topk_asc", _TOP.format("ASC NULLS FIRST", 20))(lambda t: A.top_k(t.orders, "o_totalprice", 20, "o_orderkey").select("o_orderkey", "o_totalprice"))
query("topk_desc", _TOP.format("DESC NULLS LAST", 20))(lambda t: A.top_k(t.orders, "o_totalprice", 20, "o_orderkey", True).select("o_orderkey", "o_totalprice"))
query("range_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice, o_orderkey LIMIT 10")(
    lambda t: A.top_k(t.orders.where(c("o_totalprice") >= 100000), "o_totalprice", 10, "o_orderkey").select("o_orderkey", "o_totalprice")
)
query("keyset_page", "SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority, o_orderkey) > ('2-HIGH', 50) ORDER BY o_orderpriority, o_orderkey LIMIT 25")(
    lambda t: A.keyset_page(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", ("2-HIGH", 50), 25)
)
query("order_by_pk_desc", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 20 ORDER BY o_orderkey DESC")(
    lambda t: t.orders.where("o_orderkey >= 20").select("o_orderkey").orderBy(c("o_orderkey").desc())
)
query("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 30")(
    lambda t: t.customer.select("c_custkey", "c_acctbal").orderBy(c("c_acctbal").desc(), "c_custkey").offset(30).limit(10)
)
query("lex_order", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")(
    lambda t: t.part.select("p_partkey", "p_name").orderBy("p_name", "p_partkey")
)
query("multi_key_sort", "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment, c_custkey")(
    lambda t: t.customer.select("c_nationkey", "c_mktsegment", "c_custkey").orderBy(c("c_nationkey").desc(), "c_mktsegment", "c_custkey")
)

# --- aggregates ------------------------------------------------------------------------------------------------------

query("count_star", "SELECT count(*) AS n FROM orders")(lambda t: A.row_count(t.orders))
query("count_filtered", "SELECT count(*) AS n FROM orders WHERE o_totalprice >= 150000")(lambda t: A.row_count(t.orders.where("o_totalprice >= 150000")))
query("min_max", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")(
    lambda t: t.orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
)
query("endpoint_max", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1")(
    lambda t: t.orders.select("o_totalprice").orderBy(c("o_totalprice").desc()).limit(1)
)
query(
    "sum_avg_group",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)(
    lambda t: t.lineitem.where(c("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    .groupBy("l_returnflag", "l_linestatus")
    .agg(total("l_quantity", "qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count("*").alias("n"))
)
query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")
)
query("count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")(
    lambda t: t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))
)
query("group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")(
    lambda t: t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))
)
_SALES = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY "
query("rollup", _SALES + "ROLLUP (l_returnflag, l_linestatus)")(lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(total("l_quantity", "qty")))
query("cube", _SALES + "CUBE (l_returnflag, l_linestatus)")(lambda t: t.lineitem.cube("l_returnflag", "l_linestatus").agg(total("l_quantity", "qty")))
query("grouping_sets", _SALES + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")(
    lambda t: t.lineitem.groupingSets([[c("l_returnflag")], [c("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(total("l_quantity", "qty"))
)
query("data_length", "SELECT count(*) * 200 AS bytes FROM lineitem")(lambda t: t.lineitem.agg((F.count(F.lit(1)) * 200).alias("bytes")))
query("pivot", """SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY l_returnflag""")(
    lambda t: t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 2)).withColumnsRenamed({"O": "o", "F": "f"})
)

# --- joins, subqueries, sets -----------------------------------------------------------------------------------------

query("join_inner_broadcast", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).select("c_custkey", "n_name", "r_name")
)
_BIG = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000)"


def _big(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 250000").select("o_orderkey", "o_custkey")


query("join_left", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_BIG} o ON c_custkey = o_custkey")(
    lambda t: t.customer.join(_big(t), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")
)
query("join_right", f"SELECT c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN {_BIG} o ON c_custkey = o_custkey")(
    lambda t: t.customer.where("c_acctbal > 5000").join(_big(t), c("c_custkey") == c("o_custkey"), "right").select("c_name", "o_orderkey")
)
query("join_full", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN {_BIG} o ON c_custkey = o_custkey")(
    lambda t: t.customer.where("c_acctbal > 5000").join(_big(t), c("c_custkey") == c("o_custkey"), "full").select("c_custkey", "o_orderkey")
)
query("join_cross", "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")(
    lambda t: t.region.select(c("r_name").alias("a")).crossJoin(F.broadcast(t.nation.select(c("n_name").alias("b"))))  # 5 and 25 rows
)
query("join_theta", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey AND a.s_acctbal > 5000")(
    lambda t: t.supplier.where("s_acctbal > 5000").join(F.broadcast(t.nation), c("s_nationkey") < c("n_nationkey")).select(c("s_suppkey").alias("a"), c("n_nationkey").alias("b"))
)
query("semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")(
    lambda t: t.customer.join(t.orders.where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")
)
query("anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(
    lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")
)
query(
    "join_multiway",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 GROUP BY n_name""",
)(
    lambda t: t.lineitem.join(t.orders.where("o_totalprice > 100000"), c("l_orderkey") == c("o_orderkey"))
    .join(t.customer, c("o_custkey") == c("c_custkey"))
    .join(t.nation, c("c_nationkey") == c("n_nationkey"))
    .groupBy("n_name")
    .agg(total(c("l_extendedprice") * (1 - c("l_discount")), "revenue"))
)
query("derived_table", "SELECT max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
)


def _sql(t: Tables, text: str, *names: str) -> DataFrame:
    """A SQL text over some of the tables, which are its parameters."""
    return t.spark.sql(text, **{n: getattr(t, n) for n in names})


query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")(
    lambda t: _sql(t, "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", "orders")
)
query("exists_correlated", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)")(
    lambda t: _sql(t, "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)", "supplier", "lineitem")
)
query("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")(
    lambda t: t.orders.join(t.customer.where("c_nationkey = 3"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")
)
query("not_in_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")(
    lambda t: _sql(t, "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000)", "nation", "supplier")
)
query("prepared_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")(
    lambda t: t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000, "status": "O"}, orders=t.orders)
)
_NATIONS = ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")


def _nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.where("c_acctbal > 8000").select(c("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 5000").select(c("s_nationkey").alias("k"))


query("union_all", " UNION ALL ".join(_NATIONS))(lambda t: _nations(t)[0].union(_nations(t)[1]))
query("union_distinct", " UNION ".join(_NATIONS))(lambda t: _nations(t)[0].union(_nations(t)[1]).distinct())
query("intersect", " INTERSECT ".join(_NATIONS))(lambda t: _nations(t)[0].intersect(_nations(t)[1]))
query("except", " EXCEPT ".join(_NATIONS))(lambda t: _nations(t)[0].subtract(_nations(t)[1]))
query("intersect_all", " INTERSECT ALL ".join(_NATIONS))(lambda t: _nations(t)[0].intersectAll(_nations(t)[1]))
query("except_all", " EXCEPT ALL ".join(_NATIONS))(lambda t: _nations(t)[0].exceptAll(_nations(t)[1]))

# --- windows ---------------------------------------------------------------------------------------------------------



def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def _by_priority():
    return Window.partitionBy("o_custkey").orderBy("o_orderpriority")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
query("row_number", f"SELECT o_orderkey, row_number() {_OVER}) AS rn FROM orders")(lambda t: t.orders.select("o_orderkey", F.row_number().over(_by_customer()).alias("rn")))
query("rank_dense", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")(
    lambda t: t.orders.select("o_orderkey", F.rank().over(_by_priority()).alias("r"), F.dense_rank().over(_by_priority()).alias("d"))
)
query("lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {_OVER}) AS prev, lead(o_orderkey) {_OVER}) AS nxt FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.lag("o_orderkey").over(_by_customer()).alias("prev"), F.lead("o_orderkey").over(_by_customer()).alias("nxt"))
)
query("running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) {_OVER} ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_customer().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))
)
query("ntile_first_last", f"SELECT o_orderkey, CAST(ntile(4) {_OVER}) AS BIGINT) AS quarter, first_value(o_orderkey) {_OVER}) AS f, last_value(o_orderkey) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")(
    lambda t: t.orders.select(
        "o_orderkey",
        F.ntile(4).over(_by_customer()).cast("long").alias("quarter"),
        F.first("o_orderkey").over(_by_customer()).alias("f"),
        F.last("o_orderkey").over(_by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("l"),
    )
)
query("moving_average", f"SELECT o_orderkey, round(avg(o_totalprice) {_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_customer().rowsBetween(-2, 0)), 4).alias("m"))
)
query("top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")(
    lambda t: t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey")).alias("rn"))
    .where("rn <= 2")
    .select("o_custkey", "o_orderkey")
)

# --- expiry: event rows that live an hour to some days, as of one moment ----------------------------------------------

_AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"
_EXPIRING = """(SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE ts + CAST(user_id % 9 + 1 AS INTEGER) * INTERVAL 1 DAY END AS e FROM events)"""


def _as_of() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


def _expiring(t: Tables) -> DataFrame:
    later = F.expr("CASE WHEN user_id % 10 = 0 THEN NULL ELSE ts + make_dt_interval(CAST(user_id % 9 + 1 AS INT)) END")
    return t.events.select("event_id", "user_id", later.alias("e"))


query("ttl_live_rows", f"SELECT event_id FROM {_EXPIRING} WHERE e IS NULL OR e > {_AS_OF}")(lambda t: X.live_rows(_expiring(t), c("e"), _as_of()).select("event_id"))
query(
    "ttl_remaining_seconds",
    f"""SELECT event_id, CASE WHEN e IS NULL THEN -1 ELSE CAST(ceil((epoch_us(e) - epoch_us({_AS_OF})) / 1000000.0) AS BIGINT) END AS ttl
        FROM {_EXPIRING} WHERE e IS NULL OR e > {_AS_OF}""",
)(lambda t: X.live_rows(_expiring(t), c("e"), _as_of()).select("event_id", X.remaining_seconds(c("e"), _as_of()).alias("ttl")))
query("ttl_count_live", f"SELECT count(*) AS n FROM {_EXPIRING} WHERE e IS NULL OR e > {_AS_OF}")(lambda t: A.row_count(X.live_rows(_expiring(t), c("e"), _as_of())))
query("ttl_sweep_candidates", f"SELECT event_id FROM {_EXPIRING} WHERE e <= {_AS_OF}")(lambda t: X.expired_rows(_expiring(t), c("e"), _as_of()).select("event_id"))
_WRITTEN = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE -1 END AS ttl FROM events)"


def _written(t: Tables) -> DataFrame:
    ttl = F.when(c("event_id") % 4 == 0, 60).when(c("event_id") % 4 == 1, 0).when(c("event_id") % 4 == 2, F.lit(None)).otherwise(-1)
    return t.events.select("event_id", ttl.cast("long").alias("ttl"))


query(
    "ttl_default_override",
    f"""SELECT event_id, CASE WHEN coalesce(ttl, 3600) > 0 THEN {_AS_OF} + CAST(coalesce(ttl, 3600) AS INTEGER) * INTERVAL 1 SECOND WHEN ttl < 0 THEN {_AS_OF} END AS e FROM {_WRITTEN}""",
)(lambda t: _written(t).select("event_id", X.expiry_of(c("ttl"), 3600, _as_of()).cast("timestamp_ntz").alias("e")))
query("ttl_soft_delete", f"SELECT event_id FROM {_WRITTEN} WHERE ttl IS NULL OR ttl >= 0")(
    lambda t: X.live_rows(_written(t).withColumn("e", X.expiry_of(c("ttl"), 3600, _as_of())), c("e"), _as_of().cast("timestamp")).select("event_id")
)
query("ttl_update_keeps", f"SELECT event_id, e, CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id END AS user_id FROM {_EXPIRING} WHERE e IS NULL OR e > {_AS_OF}")(
    lambda t: C.update(X.live_rows(_expiring(t), c("e"), _as_of()), c("user_id") % 2 == 0, {"user_id": c("user_id") + 1})
)

# --- changes: some orders rewritten, some new --------------------------------------------------------------------------

_OLD = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders)"
_NEW = "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0)"


def _old(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


def _new(t: Tables) -> DataFrame:
    key = F.when(c("o_orderkey") % 2 == 0, c("o_orderkey")).otherwise(c("o_orderkey") + 10000000)
    return t.orders.where("o_orderkey % 7 = 0").select(key.alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), (c("o_totalprice") + 1).alias("o_totalprice"))


query("insert_conflicts", f"SELECT n.* FROM {_NEW} n WHERE o_orderkey IN (SELECT o_orderkey FROM orders)")(lambda t: C.conflicts(_old(t), _new(t), "o_orderkey"))
query("insert_ignore", f"SELECT * FROM {_OLD} UNION ALL SELECT n.* FROM {_NEW} n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")(
    lambda t: C.insert_ignore(_old(t), _new(t), "o_orderkey")
)
query(
    "on_duplicate_update",
    f"""SELECT coalesce(a.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN n.o_orderstatus WHEN n.o_orderkey IS NULL THEN a.o_orderstatus END AS o_orderstatus,
        CASE WHEN a.o_orderkey IS NULL THEN n.o_totalprice WHEN n.o_orderkey IS NULL THEN a.o_totalprice ELSE a.o_totalprice + n.o_totalprice END AS o_totalprice
        FROM {_OLD} a FULL JOIN {_NEW} n ON a.o_orderkey = n.o_orderkey""",
)(
    lambda t: C.on_duplicate(
        _old(t), _new(t), "o_orderkey", {"o_orderstatus": F.lit(None).cast("string"), "o_totalprice": c("old.o_totalprice") + c("new.o_totalprice")}
    )
)
query("replace_upsert", f"SELECT * FROM {_OLD} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}")(
    lambda t: C.replace(_old(t), _new(t), "o_orderkey")
)
query("update_set_null", f"SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM {_OLD}")(
    lambda t: C.update(_old(t), c("o_totalprice") > 200000, {"o_orderstatus": F.lit(None).cast("string")})
)
query("update_pk_conflict", "SELECT o_orderkey + 1 AS o_orderkey FROM orders WHERE o_orderkey % 1000 = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 <> 0)")(
    lambda t: C.conflicts(t.orders.where("o_orderkey % 1000 <> 0"), t.orders.where("o_orderkey % 1000 = 0").select((c("o_orderkey") + 1).alias("o_orderkey")), "o_orderkey")
)
query("delete_where", f"SELECT * FROM {_OLD} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")(
    lambda t: C.delete(_old(t), (c("o_orderstatus") == "F") & (c("o_totalprice") < 50000))
)
query("latest_version", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")(
    lambda t: _latest(t)
)


def _latest(t: Tables) -> DataFrame:
    from .storage import latest_versions

    return latest_versions(t.events.select("user_id", "event_id", "value"), "user_id", "event_id")


query("auto_increment_assign", "SELECT e.event_id, 5000 + row_number() OVER (ORDER BY event_id) - 1 AS id FROM events e")(
    lambda t: C.with_next_ids(t.events.select("event_id", F.lit(None).cast("long").alias("id")), "id", 5000, ["event_id"])
)
query("unique_violations", "SELECT k, count(*) AS n FROM (SELECT l_orderkey * 100 + l_linenumber AS k FROM lineitem) x GROUP BY k HAVING count(*) > 1")(
    lambda t: C.violations(t.lineitem.select((c("l_orderkey") * 100 + c("l_linenumber")).alias("k")), "k")
)
query("row_size_violations", "SELECT doc_id, strlen(text) + strlen(source) + 10 AS bytes FROM documents WHERE strlen(text) + strlen(source) + 10 > 8000")(
    lambda t: t.documents.select("doc_id", C.row_bytes(t.documents, ["text", "source"]).cast("long").alias("bytes")).where("bytes > 8000")
)
query(
    "reconcile_diff",
    f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'orphan' ELSE 'stale' END AS kind
        FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice""",
)(lambda t: C.difference(_old(t), _new(t), "o_orderkey"))

# --- scalar functions ---------------------------------------------------------------------------------------------------

query("json_canonical", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")(lambda t: t.events.select("event_id", json_canonical(c("props")).alias("props")))
query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
)
query(
    "string_functions",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS lo, substr(c_name, 1, 8) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS swapped,
       concat(c_mktsegment, ':', c_name) AS both_, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, strpos(c_name, '#') AS at, reverse(c_mktsegment) AS rev FROM customer""",
)(
    lambda t: t.customer.select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("lo"), F.substring("c_name", 1, 8).alias("head"), F.length("c_name").cast("long").alias("n"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("swapped"), F.concat_ws(":", "c_mktsegment", "c_name").alias("both_"),
        F.lpad(c("c_nationkey").cast("string"), 4, "0").alias("padded"), F.instr("c_name", "#").cast("long").alias("at"), F.reverse("c_mktsegment").alias("rev"),
    )
)
query(
    "date_functions",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day,
       date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
)(
    lambda t: t.orders.select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.day("o_orderdate").cast("long").alias("d"),
        F.date_format(F.trunc(c("o_orderdate").cast("date"), "month"), "yyyy-MM-dd").alias("first_day"), F.datediff(c("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"),
    )
)
query(
    "math_functions",
    "SELECT o_orderkey, round(o_totalprice, 1) AS r, floor(o_totalprice) AS f, ceil(o_totalprice) AS ce, abs(o_totalprice - 100000) AS a, o_orderkey % 7 AS m, o_orderkey // 7 AS q, round(sqrt(o_totalprice), 4) AS s FROM orders",
)(
    lambda t: t.orders.select(
        "o_orderkey", F.round("o_totalprice", 1).alias("r"), F.floor("o_totalprice").cast("double").alias("f"), F.ceil("o_totalprice").cast("double").alias("ce"),
        F.abs(c("o_totalprice") - 100000).alias("a"), (c("o_orderkey") % 7).alias("m"), F.expr("o_orderkey div 7").alias("q"), F.round(F.sqrt("o_totalprice"), 4).alias("s"),
    )
)
query(
    "conditional_functions",
    f"SELECT c_custkey, coalesce(seg, 'none') AS seg, CASE WHEN seg IS NULL THEN 1 ELSE 0 END AS missing, greatest(c_custkey, 100) AS g, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM {_HOLED}",
)(
    lambda t: _holed(t).select(
        "c_custkey", F.coalesce("seg", F.lit("none")).alias("seg"), F.when(c("seg").isNull(), 1).otherwise(0).alias("missing"),
        F.greatest("c_custkey", F.lit(100).cast("long")).alias("g"), F.when(c("c_custkey") % 2 == 0, "even").otherwise("odd").alias("parity"),
    )
)
query("cast_try", "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS n, TRY_CAST(c_mktsegment AS BIGINT) AS bad FROM customer")(
    lambda t: t.customer.select("c_custkey", F.expr("try_cast(substr(c_name, 10) AS BIGINT)").alias("n"), F.expr("try_cast(c_mktsegment AS BIGINT)").alias("bad"))
)
query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda t: _windows(t)
)


def _windows(t: Tables) -> DataFrame:
    from .streaming.events import tumbling

    return tumbling(t.events, "1 hour").select(c("w").cast("timestamp_ntz").alias("w"), "event_type", "n")

# --- more windows over events -------------------------------------------------------------------------------------------

query("sliding_window", """SELECT time_bucket(INTERVAL 1 HOUR, ts) - CAST(k AS INTEGER) * INTERVAL 1 HOUR AS w, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2""")(
    lambda t: _sliding(t)
)
query(
    "session_windows",
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
       numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
       SELECT user_id, min(ts) AS begin_, max(ts) + INTERVAL 1 DAY AS end_, count(*) AS n FROM numbered GROUP BY user_id, s""",
)(lambda t: _sessions(t))


def _sliding(t: Tables) -> DataFrame:
    from .streaming.events import tumbling

    return tumbling(t.events, "2 hours", slide="1 hour").select(c("w").cast("timestamp_ntz").alias("w"), "event_type", "n")


def _sessions(t: Tables) -> DataFrame:
    from .streaming.events import sessions

    return sessions(t.events, "1 day").select("user_id", c("begin").cast("timestamp_ntz").alias("begin_"), c("end").cast("timestamp_ntz").alias("end_"), "n")


# --- the engine itself: statements over a snapshot table, and what is read back ---------------------------------------------


def _engine(t: Tables, table, clock=None):
    import uuid

    from .engine import Engine, now
    from .scratch import shared_folder

    engine = Engine(t.spark, f"{shared_folder(t.spark)}/tables-{uuid.uuid4().hex}", clock or now)
    engine.create_table(table)
    return engine


def _snapshot(t: Tables) -> DataFrame:
    from .catalog import Column as Field
    from .catalog import Index, Table

    fields = [Field("o_orderkey", "bigint"), Field("o_orderstatus", "varchar(8)"), Field("o_totalprice", "double")]
    engine = _engine(t, Table("o", fields, "o_orderkey", indexes=[Index("p", "o_totalprice")]))
    engine.insert("o", _old(t))
    engine.compact("o", ["o_orderkey"])
    engine.insert("o", _new(t), "replace")
    engine.update("o", c("o_totalprice") > 200000, {"o_orderstatus": F.lit(None)})
    engine.delete("o", (c("o_orderstatus") == "F") & (c("o_totalprice") < 50000))
    return engine.table("o", ttl=False)


query(
    "snapshot_statements",
    f"""SELECT * FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice
        FROM (SELECT * FROM {_OLD} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}) u) v
        WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 50000, FALSE)""",
)(_snapshot)


def _snapshot_expiry(t: Tables) -> DataFrame:
    import datetime as dt

    from .catalog import TTL, Table
    from .catalog import Column as Field

    moments = [dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc)]
    engine = _engine(t, Table("e", [Field("event_id", "bigint")], "event_id", default_ttl=3600), lambda: moments[-1])
    engine.insert("e", _written(t).withColumnRenamed("ttl", TTL))
    moments.append(moments[0] + dt.timedelta(seconds=45))
    return engine.table("e").select("event_id", c(TTL).alias("ttl"))


query(
    "snapshot_expiry",
    f"SELECT event_id, CAST(CASE WHEN ttl = 0 THEN -1 ELSE coalesce(ttl, 3600) - 45 END AS BIGINT) AS ttl FROM {_WRITTEN} WHERE coalesce(ttl, 3600) >= 0",
)(_snapshot_expiry)

from . import session_queries  # noqa: E402, F401  registers more, by the functions above
