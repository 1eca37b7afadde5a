"""Registered queries that go through ``Session.sql``: statements over stored tables, and what is read back from them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import VERSION
from .engine import Engine
from .errors import StaleVersion
from .queries import Tables, query
from .scratch import shared_folder
from .session import Session

ORDERS = "CREATE TABLE o (k BIGINT PRIMARY KEY, cust BIGINT, status VARCHAR(8), price DOUBLE, KEY i_price (price), KEY i_status (status), KEY i_cust (cust))"
CUSTOMERS = "CREATE TABLE cu (k BIGINT PRIMARY KEY, name VARCHAR(32), seg VARCHAR(16), KEY i_seg (seg))"
MOMENT = dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc)

_O = "SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders"
_NEW = "SELECT CASE WHEN k % 2 = 0 THEN k ELSE k + 10000000 END AS k, cust, 'N' AS status, price + 1 AS price FROM ({0}) WHERE k % 7 = 0"


def opened(t: Tables, *tables: str, clock: Callable[[], dt.datetime] | None = None) -> Session:
    """A session over a new folder, with the tables, and the given ones of the driver's as views to insert from."""
    for name in ("orders", "customer", "events"):
        getattr(t, name).createOrReplaceTempView(f"src_{name}")
    session = Session(Engine(t.spark, f"{shared_folder(t.spark)}/session-{uuid.uuid4().hex}", clock or (lambda: MOMENT)), scan_limit=1 << 60)
    for text in tables:
        session.sql(text)
    return session


def src(sql: str) -> str:
    return sql.replace("FROM orders", "FROM src_orders").replace("FROM customer", "FROM src_customer").replace("FROM events", "FROM src_events")


def loaded(t: Tables) -> Session:
    s = opened(t, ORDERS, CUSTOMERS)
    s.sql("INSERT INTO o (k, cust, status, price) " + src(_O))
    s.sql("INSERT INTO cu (k, name, seg) SELECT c_custkey, c_name, c_mktsegment FROM src_customer")
    return s


def orders(t: Tables) -> Session:
    s = opened(t, ORDERS)
    s.sql("INSERT INTO o (k, cust, status, price) " + src(_O))
    return s


def after(name: str, sql: str, *statements: str, read: str = "SELECT k, cust, status, price FROM o", args: list | None = None) -> None:
    """Registers what a table of all orders holds after some statements; ``args`` go to each of them."""

    def run(t: Tables) -> DataFrame:
        s = orders(t)
        for text in statements:
            s.sql(src(text), args)
        return s.sql(read)

    query(name, sql)(run)


_NEWS = _NEW.format(_O)
_REST = f"SELECT * FROM ({_O}) WHERE k NOT IN (SELECT k FROM ({_NEWS}))"

after("session_insert", _O)
after("session_insert_ignore", f"{_O} UNION ALL SELECT * FROM ({_NEWS}) WHERE k NOT IN (SELECT o_orderkey FROM orders)", f"INSERT IGNORE INTO o (k, cust, status, price) {_NEWS}")
after("session_replace", f"{_REST} UNION ALL {_NEWS}", f"REPLACE INTO o (k, cust, status, price) {_NEWS}")
after(
    "session_on_duplicate",
    f"""SELECT coalesce(a.k, n.k) AS k, coalesce(a.cust, n.cust) AS cust, CASE WHEN a.k IS NULL OR n.k IS NULL THEN coalesce(a.status, n.status) ELSE a.status || ', = ' || n.status END AS status,
        CASE WHEN a.k IS NULL OR n.k IS NULL THEN coalesce(a.price, n.price) ELSE a.price + 2 * n.price END AS price FROM ({_O}) a FULL JOIN ({_NEWS}) n ON a.k = n.k""",
    f"INSERT INTO o (k, cust, status, price) {_NEWS} ON DUPLICATE KEY UPDATE status = CONCAT(status, ', = ', VALUES(status)), price = price + 2 * VALUES(price)",
)
after(
    "session_update",
    f"SELECT k, cust, CASE WHEN price > 200000 THEN 'a WHERE b, c = d' WHEN price < 10000 THEN NULL ELSE status END AS status, price FROM ({_O})",
    "UPDATE o SET status = 'a WHERE b, c = d' WHERE price > 200000",
    "UPDATE o SET status = NULL WHERE price < 10000 AND status <> ' LIMIT 1'",
)
after(
    "session_update_limit",
    f"SELECT k, cust, status, CASE WHEN row_number() OVER (ORDER BY price DESC, k) <= 40 THEN -price ELSE price END AS price FROM ({_O})",
    "UPDATE o SET price = -price ORDER BY price DESC LIMIT 40",
)
after("session_update_key", f"SELECT CASE WHEN status = 'F' THEN k + 10000000 ELSE k END AS k, cust, status, price FROM ({_O})", "UPDATE o SET k = k + 10000000 WHERE status = 'F'")
after("session_delete", f"SELECT * FROM ({_O}) WHERE NOT (status = 'F' AND price < 50000)", "DELETE FROM o WHERE status = ? AND price < ?", args=["F", 50000])
after(
    "session_delete_limit", f"SELECT k, cust, status, price FROM (SELECT *, row_number() OVER (ORDER BY price, k) AS n FROM ({_O})) WHERE n > 100", "DELETE FROM o ORDER BY price LIMIT 100"
)


def reading(name: str, sql: str, text: str, args: list | None = None) -> None:
    """Registers a query over loaded tables; ``sql`` is its counterpart over the driver's."""
    query(name, sql)(lambda t: loaded(t).sql(text, args))


reading("session_point", f"SELECT price, k FROM ({_O}) WHERE k IN (32, 7, 1)", "SELECT price, k FROM main.o WHERE k IN (?, ?, ?)", [32, 7, 1])
reading("session_topk", f"SELECT k, price FROM ({_O}) WHERE price >= 100000 ORDER BY price DESC, k LIMIT 20", "SELECT k, price FROM o WHERE price >= 100000 ORDER BY price DESC, k LIMIT 20")
reading(
    "session_keyset", f"SELECT k, status FROM ({_O}) WHERE (status, k) > ('F', 100) ORDER BY status, k LIMIT 30",
    "SELECT k, status FROM o WHERE status > 'F' OR status = 'F' AND k > 100 ORDER BY status, k LIMIT 30",
)
reading("session_covering", f"SELECT k, price FROM ({_O}) WHERE price BETWEEN 50000 AND 90000", "SELECT k, price FROM o WHERE price BETWEEN 50000 AND 90000")
reading("session_prefix", "SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_mktsegment LIKE 'B%'", "SELECT k, seg FROM cu WHERE seg LIKE 'B%'")
reading("session_group", f"SELECT status, count(*) AS n, round(sum(price), 2) AS total FROM ({_O}) GROUP BY status", "SELECT status, count(*) AS n, round(sum(price), 2) AS total FROM o GROUP BY status")
reading(
    "session_join", f"SELECT c_mktsegment AS seg, count(*) AS n, round(sum(price), 2) AS total FROM ({_O}) o JOIN customer ON c_custkey = cust GROUP BY 1",
    "SELECT cu.seg, count(*) AS n, round(sum(o.price), 2) AS total FROM o JOIN cu ON cu.k = o.cust GROUP BY cu.seg",
)
reading("session_count", "SELECT count(*) AS n FROM orders", "SELECT COUNT(*) AS n FROM o")
reading(
    "session_describe",
    """SELECT * FROM (VALUES ('k', 'bigint', 'NO', 'PRI', CAST(NULL AS VARCHAR), ''), ('cust', 'bigint', 'YES', 'MUL', NULL, ''), ('status', 'varchar(8)', 'YES', 'MUL', NULL, ''),
       ('price', 'double', 'YES', 'MUL', NULL, '')) t("Field", "Type", "Null", "Key", "Default", "Extra")""",
    "DESCRIBE o",
)
reading(
    "session_show_index",
    """SELECT * FROM (VALUES ('cu', 0, 'PRIMARY', 1, 'k', 'PRIMARY'), ('cu', 1, 'i_seg', 1, 'seg', 'EQ')) t("Table", "Non_unique", "Key_name", "Seq_in_index", "Column_name", "Index_type")""",
    "SHOW INDEX FROM cu",
)

_TIMED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE -1 END AS ttl FROM events"


def _session_expiry(t: Tables) -> DataFrame:
    """Rows with their own time, none, the table's and one that is over; then time passes, and some rows are written again."""
    at = [MOMENT]
    s = opened(t, """CREATE TABLE e (event_id BIGINT PRIMARY KEY, v INT) COMMENT 'o:{"default_ttl": 3600}'""", clock=lambda: at[-1])
    s.sql(f"INSERT INTO e (event_id, _ttl) {src(_TIMED)}")
    at.append(MOMENT + dt.timedelta(seconds=45))
    s.sql("UPDATE e SET v = 1 WHERE event_id % 8 = 0")  # keeps its time
    s.sql("UPDATE e SET _ttl = 500 WHERE event_id % 8 = 2")
    at.append(MOMENT + dt.timedelta(seconds=61))
    return s.sql("SELECT event_id, v, _ttl AS ttl FROM e")


query(
    "session_expiry",
    f"""SELECT event_id, CAST(NULL AS INTEGER) AS v, CAST(CASE WHEN ttl = 0 THEN -1 WHEN event_id % 8 = 2 THEN 484 ELSE 3600 - 61 END AS BIGINT) AS ttl FROM ({_TIMED}) WHERE ttl IS NULL OR ttl = 0""",
)(_session_expiry)


def _session_auto_increment(t: Tables) -> DataFrame:
    s = opened(t, "CREATE TABLE a (id BIGINT AUTO_INCREMENT PRIMARY KEY, price DOUBLE, k BIGINT)")
    s.sql("INSERT INTO a (id, price, k) VALUES (5, 0.0, -1)")
    s.sql("INSERT INTO a (price, k) SELECT o_totalprice, o_orderkey FROM src_orders")
    return s.sql("SELECT id, k, price FROM a")


query(
    "session_auto_increment",
    "SELECT 5 + row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id, o_orderkey AS k, o_totalprice AS price FROM orders UNION ALL SELECT 5, -1, 0.0",
)(_session_auto_increment)

#: JSON texts, and the one form in which each is kept.
JSON_FORMS = [
    ('{"b":1,"a":2}', '{"a":2,"b":1}'), ('{"a": [1, 2.0, 3.50]}', '{"a":[1,2,3.5]}'), ("[]", "[]"), ("{}", "{}"), ('{"a":1,"a":2}', '{"a":2}'), ('"x"', '"x"'), ("1e2", "100"),
    ('{"z":{"y":1,"x":null}}', '{"z":{"x":null,"y":1}}'), ("true", "true"), ('{"é":"ü"}', '{"é":"ü"}'),
]


def _session_json(t: Tables) -> DataFrame:
    s = opened(t, "CREATE TABLE j (id INT PRIMARY KEY, body JSON)")
    for first in (0, 5):
        part = list(enumerate(JSON_FORMS))[first : first + 5]
        s.sql(f"INSERT INTO j VALUES {', '.join('(?, ?)' for _ in part)}", [x for i, (text, _) in part for x in (i, text)])
    return s.sql("SELECT id, body FROM j")


query("session_json", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{form}')" for i, (_, form) in enumerate(JSON_FORMS)) + ") t(id, body)")(_session_json)


def _session_versions(t: Tables) -> DataFrame:
    """A write at the versions read, then one at versions that are old by now: the second changes nothing."""
    s = orders(t)
    read = s.engine.versions("o")
    some = read.where("k % 3 = 0").join(s.engine.table("o", ttl=False), "k").withColumn("status", F.lit("1"))
    held = t.spark.createDataFrame(read.where("k % 3 = 0").limit(1).collect(), read.schema)
    s.engine.compare_and_set("o", some)
    try:
        s.engine.compare_and_set("o", held.withColumn("status", F.lit("2")))
    except StaleVersion:
        s.sql("UPDATE o SET price = 0 WHERE status = '1'")
    return s.engine.table("o", ttl=False).join(s.engine.versions("o").withColumnRenamed(VERSION, "version"), "k")


query("session_versions", f"SELECT k, cust, CASE WHEN k % 3 = 0 THEN '1' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN 0 ELSE price END AS price, CAST(CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS version FROM ({_O})")(
    _session_versions
)


def _session_reconcile(t: Tables) -> DataFrame:
    s = orders(t)
    s.sql("DELETE FROM o WHERE k % 5 = 0")
    s.sql("UPDATE o SET price = price + 1 WHERE k % 7 = 0")
    s.sql("INSERT INTO o (k, cust, status, price) VALUES (-1, 1, 'x', 1.0)")
    return s.engine.reconcile("o", t.spark.sql(src(_O)))


query(
    "session_reconcile",
    f"SELECT k, CASE WHEN k % 5 = 0 THEN 'orphan' ELSE 'stale' END AS kind FROM ({_O}) WHERE k % 5 = 0 OR k % 7 = 0 UNION ALL SELECT -1, 'missing'",
)(_session_reconcile)


def _approx_distinct(t: Tables) -> DataFrame:
    """Whether the estimates are near the exact counts: within five standard errors of the sketches."""
    exact = F.count_distinct("l_partkey").alias("a"), F.count_distinct("l_suppkey").alias("b")
    rough = F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 12)).alias("parts"), F.approx_count_distinct("l_suppkey", 0.02).alias("suppliers")
    near = lambda x, n, e: (F.abs(F.col(x) - F.col(n)) <= e * F.col(n) + 1).alias(x)
    return t.lineitem.agg(*rough).crossJoin(t.lineitem.agg(*exact)).select("a", "b", near("parts", "a", 0.08), near("suppliers", "b", 0.1))  # one row each


query("approx_distinct", "SELECT count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b, TRUE AS parts, TRUE AS suppliers FROM lineitem")(_approx_distinct)
