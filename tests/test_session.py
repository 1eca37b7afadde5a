"""Statements whose literals look like clauses, what a session tells of its tables, and races."""

import threading

import pytest
from pyspark.sql import functions as F

from rowloom.catalog import VERSION, Column, Index, Table
from rowloom.engine import Engine
from rowloom.errors import NoIndex, StaleVersion
from rowloom.operators.changes import with_next_ids
from rowloom.plans.gate import filtered_columns
from rowloom.session import Session


@pytest.fixture
def session(spark, tmp_path):
    return Session(Engine(spark, f"file://{tmp_path}/db"))


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_literals_that_look_like_clauses(session):
    session.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, a VARCHAR(64))")
    session.sql("INSERT INTO t VALUES (1, 'x ON DUPLICATE KEY UPDATE y'), (2, 'it''s, (VALUES) WHERE ?')")
    session.sql("UPDATE t SET a = 'p WHERE q, r = 2' WHERE id = 1")
    session.sql("INSERT INTO t VALUES (?, 'a VALUES(a)') ON DUPLICATE KEY UPDATE a = CONCAT('a, VALUES(a) ', ?, VALUES(a))", [2, "it's "])
    assert values(session.sql("SELECT id, a FROM t")) == [(1, "p WHERE q, r = 2"), (2, "a, VALUES(a) it's a VALUES(a)")]
    session.sql("DELETE FROM t WHERE a = 'p WHERE q, r = 2' OR a = ' ORDER BY LIMIT 1'")
    assert values(session.sql("SELECT id FROM t WHERE a <> 'FROM x.t'")) == [(2,)]


def test_set_order_and_limit(session):
    session.sql("CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, a VARCHAR(64), n INT)")
    session.sql("INSERT INTO t SET a = 'x, y', n = 5")
    session.sql("INSERT INTO t (a, n) VALUES ('b', 1), ('c', 2), ('d', 3), ('e', 3)")
    assert values(session.sql("UPDATE t SET n = n + 10 WHERE n < 4 ORDER BY n DESC LIMIT 2")) == [(2,)]
    assert values(session.sql("SELECT a, n FROM t")) == [("b", 1), ("c", 2), ("d", 13), ("e", 13), ("x, y", 5)]
    assert values(session.sql("DELETE FROM t ORDER BY n LIMIT ?", [3])) == [(3,)]
    assert values(session.sql("SELECT a FROM t")) == [("d",), ("e",)]
    assert values(session.sql("DELETE FROM t WHERE id = 77")) == [(0,)]


def test_what_a_session_tells(session):
    made = """CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, mail VARCHAR(64), n INT NOT NULL, UNIQUE KEY m (mail), KEY k (n)) COMMENT 'o:{"default_ttl": 60}'"""
    session.sql(made)
    told = [("id", "bigint", "NO", "PRI", None, "auto_increment"), ("mail", "varchar(64)", "YES", "UNI", None, ""), ("n", "int", "NO", "MUL", None, "")]
    assert [tuple(r) for r in session.sql("DESCRIBE t").collect()] == told == [tuple(r) for r in session.sql("SHOW COLUMNS FROM t").collect()]
    assert values(session.sql("SHOW INDEX FROM t")) == [("t", 0, "PRIMARY", 1, "id", "PRIMARY"), ("t", 0, "m", 1, "mail", "UNIQUE"), ("t", 1, "k", 1, "n", "RANGE")]
    text = session.sql("SHOW CREATE TABLE t").first()[1]
    before = session.engine.definition("t")
    session.sql("DROP TABLE t")
    session.sql(text)
    assert session.engine.definition("t") == before
    for change in ("UPDATE t SET n = 1 WHERE id = 2", "DELETE FROM t WHERE mail = 'a WHERE b' LIMIT 3", "INSERT INTO t (mail, n) VALUES ('a', 1)"):
        plan = session.sql(f"EXPLAIN {change}").first()[0]
        assert "Physical Plan" in plan and "Error" not in plan
    session.sql("INSERT INTO t (mail, n) VALUES ('a', 1)")
    status = dict(values(session.sql("SHOW STATUS")))
    assert status["insert.statements"] == status["insert.rows"] == 1


def test_guard_asks_for_a_filter_on_the_table_itself(session):
    for name in ("a", "b"):
        session.sql(f"CREATE TABLE {name} (id BIGINT PRIMARY KEY, v INT)")
        session.sql(f"INSERT INTO {name} SELECT id, id FROM range(9)")
    small = Session(session.engine, scan_limit=5)
    with pytest.raises(NoIndex):
        small.sql("SELECT * FROM a JOIN b ON a.v = b.v WHERE a.id = 1")
    out = small.sql("SELECT * FROM a JOIN b ON a.v = b.v WHERE a.id = 1 AND b.id < 3")
    assert filtered_columns(out, "a") == filtered_columns(out, "b") == {"id"} and out.count() == 1


def test_versions(session, spark):
    e = session.engine
    e.create_table(Table("t", [Column("id", "bigint"), Column("v", "int")], "id", indexes=[Index("i", "v")]))
    rows = lambda *x: spark.createDataFrame(list(x), f"id long, v int, {VERSION} long")
    assert e.compare_and_set("t", rows((1, 10, None), (2, 20, None))) == 2
    seen = dict(values(e.versions("t")))
    assert e.compare_and_set("t", rows((1, 11, seen[1]))) == 1
    now = dict(values(e.versions("t")))
    assert now[1] > seen[1] and now[2] == seen[2]
    for stale in (rows((1, 12, seen[1]), (2, 21, seen[2])), rows((1, 12, None)), rows((3, 1, 1))):
        with pytest.raises(StaleVersion):
            e.compare_and_set("t", stale)
    assert values(e.table("t", ttl=False)) == [(1, 11), (2, 20)] and e.row_count("t") == 2


def test_readers_see_whole_manifests(session, spark, tmp_path):
    e = session.engine
    e.create_table(Table("t", [Column("id", "bigint")], "id"))
    e.insert("t", spark.range(3))
    folder = tmp_path / "db" / "t" / "manifest"
    (folder / ".half.tmp").write_text("{")  # a writer that has not ended
    assert e.row_count("t") == 3
    m = e.store.load("t")
    m.number += 1
    errors, threads = [], []

    def commit():
        try:
            e.store.commit("t", m)
        except StaleVersion as x:
            errors.append(x)

    for _ in range(6):
        threads.append(threading.Thread(target=commit))
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(errors) == 5 and e.row_count("t") == 3


def test_compaction_leaves_files_for_readers(session, spark):
    e = session.engine
    e.create_table(Table("t", [Column("id", "bigint")], "id"))
    e.insert("t", spark.range(5))
    reading = e.table("t")
    e.compact("t")
    assert reading.count() == 5
    e.insert("t", spark.range(5, 7))
    e.compact("t", grace=0)
    e.compact("t", grace=0)
    assert e.table("t").count() == 7 and len(e.store.load("t").retired) == 1


def test_cached_reads_follow_snapshots(session, spark):
    e = session.engine
    e.create_table(Table("t", [Column("id", "bigint")], "id"))
    e.insert("t", spark.range(5))
    assert e.cached("t").count() == e.cached("t").count() == 5
    e.delete("t", F.col("id") < 2)
    assert e.cached("t").count() == 3
    assert (e.metrics.counts["cache.hits"], e.metrics.counts["cache.misses"]) == (1, 2)


def test_drift(session, spark):
    e = session.engine
    e.create_table(Table("t", [Column("id", "bigint"), Column("v", "int")], "id", indexes=[Index("i", "v", unique=True)]))
    e.insert("t", spark.range(4).withColumn("v", F.col("id").cast("int")))
    assert e.drift("t").count() == 0
    m = e.store.load("t")  # a base that breaks the rules
    bad = e.store.read(m).unionByName(spark.createDataFrame([(1, 9, 1, None, "W"), (7, 3, 1, None, "W"), (None, 8, 1, None, "W")], m.definition.stored_schema))
    e.store.commit("t", type(m)(**m.__dict__ | {"number": m.number + 1, "base": e.store.write("t", bad), "changes": []}))
    assert values(e.drift("t").fillna("")) == [("count_wrong", "4 noted, 7"), ("key_missing", ""), ("key_repeated", "1"), ("unique_repeated", "i: 3")]
    other = spark.createDataFrame([(0, 0), (2, 5), (9, 9)], "id long, v int")
    assert ("stale" in {r.kind for r in e.reconcile("t", other).where("id = 2").collect()}) and e.reconcile("t", other).where("id = 9").first().kind == "orphan"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_auto_increment_at_size(spark, adaptive):
    """Ranges differ from plan to plan: every row must get one number all the same."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        n = 600_000
        rows = spark.range(n).select(
            F.when(F.col("id") % 10 == 0, F.col("id") + 10 * n).alias("id"), F.xxhash64("id").alias("v"), F.concat(F.repeat(F.md5(F.col("id").cast("string")), 4)).alias("wide")
        )
        out = with_next_ids(rows, "id", 7, ["v", "wide"])
        got = out.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("v")).first()
        assert tuple(got) == (n, n, n)
        new = out.where(F.col("id") < 10 * n)
        assert tuple(new.agg(F.min("id"), F.max("id")).first()) == (7, 7 + n * 9 // 10 - 1)
        low = new.where("id < 2000").orderBy("id").select("v").collect()
        assert [r.v for r in low] == sorted(r.v for r in low)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files(session, spark, tmp_path):
    from rowloom.sources import export, load, read_files

    rows = spark.range(20).select("id", (F.col("id") / 2).alias("v"), F.array("id").alias("list"), F.lit("a,b").alias("s"))
    rows.write.parquet(f"{tmp_path}/in")
    assert load(session.engine, "f", read_files(spark, f"{tmp_path}/in"), "id") == 20
    assert values(session.sql("SELECT v, list, s FROM f WHERE id = 4")) == [(2.0, "[4]", "a,b")]
    for format in ("csv", "json", "orc"):
        export(session.engine, "f", f"{tmp_path}/{format}", format)
        back = read_files(spark, f"{tmp_path}/{format}", format, "id long, v double, list string, s string")
        assert values(back) == values(session.engine.table("f", ttl=False))
    assert load(session.engine, "f", read_files(spark, f"{tmp_path}/in"), "id", "replace") == 20
