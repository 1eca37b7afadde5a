import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.catalog import Column, Index, Table
from rowloom.engine import Engine
from rowloom.errors import DuplicateKey, InvalidDefinition, NoIndex, NoSuchTable, ReadOnly, RowTooLarge, StaleVersion, TableError, Unsupported
from rowloom.session import Session


class Clock:
    def __init__(self):
        self.at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def __call__(self):
        return self.at

    def pass_(self, seconds):
        self.at += dt.timedelta(seconds=seconds)


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def engine(spark, tmp_path, clock):
    return Engine(spark, f"file://{tmp_path}/db", clock)


@pytest.fixture
def session(engine):
    return Session(engine)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_smoke(session):
    session.sql("CREATE TABLE users (uid BIGINT PRIMARY KEY, city VARCHAR(32), age INT, INDEX idx_city (city), KEY idx_age (age))")
    session.sql("INSERT INTO users VALUES (1, 'shanghai', 30), (2, 'beijing', 25), (3, 'shanghai', 40)")
    assert values(session.sql("SELECT city FROM users WHERE uid = 1")) == [("shanghai",)]
    assert values(session.sql("SELECT COUNT(*) FROM users WHERE city = 'shanghai'")) == [(2,)]
    assert values(session.sql("SELECT uid FROM users WHERE age >= 26 ORDER BY age DESC LIMIT 1")) == [(3,)]
    assert values(session.sql("SELECT age FROM users WHERE uid = ?", [1])) == [(30,)]
    assert values(session.sql("SHOW TABLES")) == [("users",)]
    assert session.sql("SELECT * FROM users").columns == ["uid", "city", "age", "_ttl"]
    with pytest.raises(DuplicateKey):
        session.sql("INSERT INTO users VALUES (4, 'x', 1), (1, 'x', 1)")
    assert session.engine.row_count("users") == 3  # the statement did not apply in part
    session.sql("DROP TABLE users")
    with pytest.raises(NoSuchTable):
        session.engine.table("users")


def test_changes(session):
    session.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(32))")
    session.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    assert values(session.sql("REPLACE INTO t VALUES (1, 'c')")) == [(1,)]
    assert values(session.sql("INSERT IGNORE INTO t VALUES (1, 'x'), (3, 'd')")) == [(1,)]
    session.sql("INSERT INTO t VALUES (3, 'e'), (4, 'f') ON DUPLICATE KEY UPDATE v = CONCAT(v, VALUES(v))")
    assert values(session.sql("SELECT id, v FROM t")) == [(1, "c"), (2, "b"), (3, "de"), (4, "f")]
    session.sql("INSERT INTO t VALUES (4, 'f') ON DUPLICATE KEY UPDATE v = NULL")
    session.sql("UPDATE t SET v = NULL WHERE id = 2")
    assert values(session.sql("SELECT id FROM t WHERE v IS NULL")) == [(2,), (4,)]
    with pytest.raises(DuplicateKey):
        session.sql("UPDATE t SET id = 1 WHERE id = 2")
    assert values(session.sql("SELECT v FROM t WHERE id = 1")) == [("c",)]
    session.sql("UPDATE t SET id = id + 10 WHERE id >= 3")
    assert values(session.sql("DELETE FROM t WHERE id > ?", [13])) == [(1,)]
    assert values(session.sql("DELETE FROM t WHERE id = 99")) == [(0,)]
    assert values(session.sql("SELECT id, v FROM t WHERE v IS NOT NULL")) == [(1, "c"), (13, "de")]
    assert session.engine.row_count("t") == 3 == session.engine.compact("t", ["id"])
    assert session.engine.row_count("t") == 3
    report = session.engine.verify("t")
    assert not any(report.values()), report


def test_unique(session):
    session.sql("CREATE TABLE u (id BIGINT PRIMARY KEY, email VARCHAR(64), UNIQUE KEY e (email))")
    session.sql("INSERT INTO u VALUES (1, 'a@x.com'), (2, NULL), (3, NULL)")
    with pytest.raises(DuplicateKey):
        session.sql("INSERT INTO u VALUES (4, 'a@x.com')")
    with pytest.raises(DuplicateKey):
        session.sql("UPDATE u SET email = 'b' WHERE id > 1")
    session.sql("CREATE TABLE u2 (id BIGINT PRIMARY KEY, email VARCHAR(64))")
    session.sql("INSERT INTO u2 VALUES (1, 'd@x.com'), (2, 'd@x.com')")
    with pytest.raises(DuplicateKey):
        session.sql("CREATE UNIQUE INDEX e ON u2 (email)")
    session.sql("CREATE INDEX e ON u2 (email)")
    session.sql("DROP INDEX e ON u2")


def test_expiry(session, clock):
    session.sql("""CREATE TABLE x (uid BIGINT PRIMARY KEY, city VARCHAR(32)) COMMENT 'o:{"default_ttl": 3600}'""")
    session.sql("INSERT INTO x (uid, city, _ttl) VALUES (1, 'a', 60), (2, 'b', 0), (3, 'c', NULL), (4, 'd', -1)")
    assert values(session.sql("SELECT uid, _ttl FROM x")) == [(1, 60), (2, -1), (3, 3600)]
    clock.pass_(10)
    session.sql("UPDATE x SET city = 'z' WHERE uid = 1")
    assert values(session.sql("SELECT uid, city, _ttl FROM x WHERE uid = 1")) == [(1, "z", 50)]
    session.sql("UPDATE x SET _ttl = 120 WHERE uid = 1")
    clock.pass_(119.5)
    assert values(session.sql("SELECT _ttl FROM x WHERE uid = 1")) == [(1,)]
    clock.pass_(1)
    assert session.engine.row_count("x") == 2
    assert values(session.sql("DELETE FROM x WHERE uid = 1")) == [(0,)]  # dead already
    session.sql("INSERT INTO x VALUES (1, 'again')")  # a dead row does not hold its key
    assert values(session.sql("SELECT uid FROM x")) == [(1,), (2,), (3,)]
    assert session.engine.verify("x")["expired"] == 1
    clock.pass_(4000)
    assert session.engine.compact("x") == 1


def test_auto_increment_and_checks(session):
    session.sql("CREATE TABLE a (id BIGINT AUTO_INCREMENT PRIMARY KEY, body JSON, at DATETIME, n INT NOT NULL)")
    session.sql("""INSERT INTO a (body, n) VALUES ('{"b":1, "a":[1.0]}', 1), (NULL, 2)""")
    session.sql("INSERT INTO a (id, n, at) VALUES (10, 3, TIMESTAMP '2024-01-01 00:00:00.9')")
    session.sql("INSERT INTO a (n) VALUES (4)")
    assert values(session.sql("SELECT n, id FROM a WHERE n > 2")) == [(3, 10), (4, 11)]
    assert values(session.sql("SELECT body FROM a WHERE body IS NOT NULL")) == [('{"a":[1],"b":1}',)]
    assert values(session.sql("SELECT CAST(at AS STRING) FROM a WHERE id = 10")) == [("2024-01-01 00:00:00",)]
    with pytest.raises(TableError):
        session.sql("INSERT INTO a (body, n) VALUES ('{bad', 1)")
    session.sql("""UPDATE a SET body = '{"z": 1, "y": 2}' WHERE n = 4""")
    assert values(session.sql("SELECT body FROM a WHERE n = 4")) == [('{"y":2,"z":1}',)]
    with pytest.raises(TableError):
        session.sql("UPDATE a SET body = 'x' WHERE n = 4")
    with pytest.raises(TableError):
        session.sql("INSERT INTO a (id) VALUES (20)")
    with pytest.raises(RowTooLarge):
        session.engine.insert("a", session.spark.range(1).select(F.lit(5).alias("n"), F.to_json(F.struct(F.repeat(F.lit("x"), 1 << 20))).alias("body")))


def test_roles_variables_and_refusals(session):
    session.sql("CREATE TABLE r (id BIGINT PRIMARY KEY, v INT, w INT, INDEX iv (v))")
    session.sql("INSERT INTO r SELECT id, id % 7, id % 5 FROM range(50)")
    reader = Session(session.engine, "ro")
    assert values(reader.sql("SELECT COUNT(*) FROM r")) == [(50,)]
    for text in ("INSERT INTO r VALUES (99, 1, 1)", "DROP TABLE r", "SET GLOBAL replica_read = 1", "CREATE TABLE q (id INT PRIMARY KEY)"):
        with pytest.raises(ReadOnly):
            reader.sql(text)
    for text in ("GRANT ALL ON r TO u", "TRUNCATE TABLE r", "BEGIN", "SAVEPOINT s", "SET autocommit = 0", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(Unsupported) as e:
            session.sql(text)
        assert e.value.code == 1235
    for text in ("CREATE TABLE c (a INT, b INT, PRIMARY KEY (a, b))", "CREATE TABLE `a:b` (a INT PRIMARY KEY)", "CREATE TABLE d (a DATETIME(6), i INT PRIMARY KEY)",
                 "CREATE TABLE e (a INT PRIMARY KEY, b INT DEFAULT 3)"):
        with pytest.raises(TableError):
            session.sql(text)
    small = Session(session.engine, scan_limit=5)
    with pytest.raises(NoIndex):
        small.sql("SELECT * FROM r WHERE w = 1")
    assert small.sql("SELECT * FROM r WHERE v = 1").count() == 7
    session.sql("SET GLOBAL query_allow_fullscan_tables = 'x, R'")
    assert small.sql("SELECT * FROM r WHERE w = 1").count() == 10
    assert values(session.sql("SHOW GLOBAL VARIABLES LIKE 'query%'")) == [("query_allow_fullscan_tables", "x, R")]
    assert session.sql("EXPLAIN SELECT * FROM r").count() == 1


def test_lost_race(engine, spark):
    engine.create_table(Table("t", [Column("id", "bigint"), Column("v", "int")], "id", indexes=[Index("i", "v")]))
    m = engine.store.load("t")
    m.number += 1
    engine.store.commit("t", m)
    with pytest.raises(StaleVersion):
        engine.store.commit("t", m)
    engine.insert("t", spark.range(5).withColumn("v", F.lit(1)))
    assert engine.row_count("t") == 5
    with pytest.raises(InvalidDefinition):
        engine.insert("t", spark.range(5).withColumn("zz", F.lit(1)))


def test_distinct_estimate(engine, spark):
    engine.create_table(Table("s", [Column("id", "bigint"), Column("v", "int")], "id"))
    engine.insert("s", spark.range(10_000).withColumn("v", (F.col("id") % 5000).cast("int")))
    assert 4500 <= engine.cardinality("s", ["v"])["v"] <= 5500


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["insert", "replace", "ignore", "update", "delete", "pass"]), st.integers(0, 5), st.sampled_from([None, 0, 30, -1])), min_size=2, max_size=5))
def test_against_a_model(spark, tmp_path_factory, steps):
    clock = Clock()
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('model')}", clock)
    engine.create_table(Table("m", [Column("id", "bigint"), Column("v", "int")], "id", default_ttl=100))
    model: dict[int, tuple[int, float | None]] = {}
    now = 0
    for n, (what, key, ttl) in enumerate(steps):
        alive = {k: x for k, x in model.items() if x[1] is None or x[1] > now}
        end = None if ttl == 0 else now + (100 if ttl is None else ttl) if ttl != -1 else now
        rows = spark.createDataFrame([(key, n, ttl)], "id long, v int, _ttl long")
        if what == "insert" and key in alive:
            with pytest.raises(DuplicateKey):
                engine.insert("m", rows)
        elif what in ("insert", "replace") or what == "ignore" and key not in alive:
            engine.insert("m", rows, "error" if what == "insert" else what)
            model[key] = (n, end)
        elif what == "update":
            assert engine.update("m", F.col("id") == key, {"v": F.lit(n)}) == (key in alive)
            if key in alive:
                model[key] = (n, model[key][1])
        elif what == "delete":
            assert engine.delete("m", F.col("id") == key) == (key in alive)
            if key in alive:
                del model[key]
        else:
            clock.pass_(20)
            now += 20
    want = sorted((k, v) for k, (v, e) in model.items() if e is None or e > now)
    assert values(engine.table("m", ttl=False)) == want
    assert engine.row_count("m") == len(want)
