"""Statements through the engine: constraints, transactions, views, triggers, privileges."""

import pytest

from quarryline.config import EngineConfig, load_config
from quarryline.engine import Engine
from quarryline.errors import ConflictError, ConstraintError, EngineError, PrivilegeError, SqlError, TransactionError


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(db, text):
    return sorted(tuple(r) for r in db.query(text).collect())


def ordered(db, text):
    return [tuple(r) for r in db.query(text).collect()]


def test_transactions(db):
    db.sql("CREATE TABLE t (id INT, name TEXT)")
    db.script("BEGIN; INSERT INTO t VALUES (1, 'alice'); ROLLBACK")
    assert rows(db, "SELECT * FROM t") == []
    db.script("BEGIN TRANSACTION; INSERT INTO t VALUES (1, 'alice'), (2, 'bob'); SAVEPOINT a; DELETE FROM t WHERE id = 1")
    assert rows(db, "SELECT id FROM t") == [(2,)]
    db.sql("ROLLBACK TO SAVEPOINT a")
    db.script("SAVEPOINT b; RELEASE SAVEPOINT b; COMMIT WORK")
    assert rows(db, "SELECT id FROM t") == [(1,), (2,)]
    with pytest.raises(TransactionError):
        db.sql("COMMIT")
    db.sql("BEGIN")
    with pytest.raises(TransactionError):
        db.sql("BEGIN")
    with pytest.raises(TransactionError):
        db.sql("ROLLBACK TO nowhere")
    db.sql("ROLLBACK")


def test_a_failed_statement_leaves_its_transaction_as_it_was(db):
    db.script("CREATE TABLE t (id INT PRIMARY KEY); BEGIN; INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t VALUES (2), (1)")
    db.sql("COMMIT")
    assert rows(db, "SELECT id FROM t") == [(1,)]


def test_catalog_survives_and_conflicts_are_seen(spark, tmp_path):
    a = Engine(spark, str(tmp_path))
    a.script("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)")
    b = Engine(spark, str(tmp_path))
    assert rows(b, "SELECT id FROM t") == [(1,)]
    a.sql("INSERT INTO t VALUES (2)")
    with pytest.raises(ConflictError):
        b.sql("INSERT INTO t VALUES (3)")
    assert rows(Engine(spark, str(tmp_path)), "SELECT id FROM t") == [(1,), (2,)]
    a.sql("DELETE FROM t WHERE id = 1")
    assert a.store.vacuum() >= 1 and rows(a, "SELECT id FROM t") == [(2,)]


@pytest.fixture
def pair(spark, tmp_path):
    """Two sessions of one folder, both of an isolation."""

    def make(isolation):
        one = Engine(spark, str(tmp_path), config=EngineConfig(isolation=isolation))
        one.script("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT REFERENCES p); CREATE TABLE u (a INT); INSERT INTO p VALUES (1), (2); INSERT INTO u VALUES (1)")
        return one, Engine(spark, str(tmp_path), config=EngineConfig(isolation=isolation))

    return make


@pytest.mark.parametrize("isolation", ["read_committed", "repeatable_read"])
def test_weaker_isolation(pair, isolation):
    a, b = pair(isolation)
    # both write, to tables that have nothing to do with each other
    a.script("BEGIN; INSERT INTO u VALUES (2); SAVEPOINT s; INSERT INTO u VALUES (3)")
    b.sql("INSERT INTO p VALUES (3)")
    assert len(rows(a, "SELECT id FROM p")) == (3 if isolation == "read_committed" else 2)
    a.script("ROLLBACK TO s; COMMIT")
    assert rows(b, "SELECT a FROM u") == [(1,), (2,)] and len(rows(a, "SELECT id FROM p")) == 3
    # to one table
    a.script("BEGIN; INSERT INTO u VALUES (4)")
    b.sql("DELETE FROM u WHERE a = 1")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    assert rows(a, "SELECT a FROM u") == [(2,)]
    # to a parent and its child
    a.script("BEGIN; INSERT INTO c VALUES (1)")
    b.sql("DELETE FROM p WHERE id = 1")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    a.script("BEGIN; DELETE FROM p WHERE id = 2")
    b.sql("INSERT INTO c VALUES (2)")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    # a definition is no table
    a.script("BEGIN; INSERT INTO u VALUES (5)")
    b.sql("CREATE VIEW v AS SELECT a FROM u")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    # a table that is dropped meanwhile
    a.script("BEGIN; INSERT INTO p VALUES (9)")
    b.script("DROP VIEW v")
    b.script("DROP TABLE u")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    with pytest.raises(Exception, match="u"):
        a.query("SELECT a FROM u").collect()


def test_dropped_tables_and_functions_of_others(pair):
    a, b = pair("read_committed")
    a.script("BEGIN; INSERT INTO p VALUES (9)")
    b.sql("DROP TABLE u")
    a.sql("COMMIT")
    with pytest.raises(Exception, match="u"):
        a.query("SELECT a FROM u").collect()
    b.sql("CREATE FUNCTION more(x INT) RETURNS TABLE (y INT) AS 'SELECT id + x FROM p'")
    assert rows(a, "SELECT y FROM more(10)") == [(11,), (12,), (19,)]
    b.sql("DROP FUNCTION more")
    with pytest.raises(Exception, match="more"):
        a.query("SELECT y FROM more(10)").collect()
    a.script("BEGIN; CREATE FUNCTION gone(x INT) RETURNS INT AS 'x'; ROLLBACK")
    with pytest.raises(Exception, match="gone"):
        a.query("SELECT gone(1)").collect()


def test_a_session_goes_on_after_a_conflict(pair):
    a, b = pair("serializable")
    a.sql("INSERT INTO u VALUES (2)")
    with pytest.raises(ConflictError):
        b.sql("INSERT INTO u VALUES (3)")
    b.sql("INSERT INTO u VALUES (3)")
    assert rows(b, "SELECT a FROM u") == [(1,), (2,), (3,)]


def test_transaction_modes(db):
    with pytest.raises(SqlError):
        db.sql("BEGIN ISOLATION LEVEL NONE")
    db.sql("SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL READ UNCOMMITTED")
    assert db.config.isolation == "read_committed"
    db.script("SET TRANSACTION ISOLATION LEVEL SNAPSHOT, READ ONLY; START TRANSACTION")
    assert (db.store.isolation, db.store.read_only) == ("repeatable_read", True)
    db.script("COMMIT; BEGIN TRANSACTION READ WRITE")
    assert (db.store.isolation, db.store.read_only) == ("read_committed", False)
    db.sql("ROLLBACK")
    with pytest.raises(ValueError):
        load_config({}, isolation="none")


def test_keys(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, email TEXT UNIQUE)")
    db.sql("INSERT INTO t VALUES (1, 'alice', 'a'), (2, 'bob', NULL), (3, 'eve', NULL)")
    for text in ("INSERT INTO t VALUES (1, 'x', 'z')", "UPDATE t SET id = 1 WHERE id = 2", "INSERT INTO t VALUES (9, 'x', 'a')", "INSERT INTO t VALUES (NULL, 'x', 'y')"):
        with pytest.raises(ConstraintError):
            db.sql(text)
    db.sql("CREATE TABLE p (a INT, b INT, c TEXT, PRIMARY KEY (a, b))")
    db.sql("INSERT INTO p VALUES (1, 1, 'x'), (1, 2, 'y')")
    with pytest.raises(ConstraintError, match="Duplicate key"):
        db.sql("INSERT INTO p VALUES (1, 2, 'z')")
    assert len(rows(db, "SELECT * FROM t")) == 3


def test_check_default_and_types(db):
    db.sql("CREATE TABLE t (age INT CHECK (age >= 0), s VARCHAR(3) DEFAULT 'n/a', d DECIMAL(4,1), b BOOLEAN, x DATE)")
    db.sql("INSERT INTO t (age) VALUES (25), (NULL)")
    assert rows(db, "SELECT s FROM t") == [("n/a",)] * 2
    with pytest.raises(ConstraintError, match="CHECK"):
        db.sql("INSERT INTO t (age) VALUES (-5)")
    with pytest.raises(ConstraintError, match="CHECK"):
        db.sql("UPDATE t SET age = age - 30")
    for bad in ("s) VALUES ('long')", "d) VALUES (1.25)", "b) VALUES ('yes')", "x) VALUES ('2024-02-30')", "age) VALUES ('word')"):
        with pytest.raises(Exception, match="does not fit"):
            db.sql(f"INSERT INTO t ({bad}")
    db.sql("INSERT INTO t (d, b, x) VALUES (1.5, 'true', '2024-02-29')")
    assert str(rows(db, "SELECT d, b, x FROM t WHERE b")[0][0]) == "1.5"


def test_null_order(db):
    db.sql("CREATE TABLE t (id INT, val INT)")
    db.sql("INSERT INTO t VALUES (1, 10), (2, NULL), (3, 30), (4, NULL)")
    assert ordered(db, "SELECT id FROM t ORDER BY val, id") == [(1,), (3,), (2,), (4,)]
    assert ordered(db, "SELECT id FROM t ORDER BY val DESC, id") == [(3,), (1,), (2,), (4,)]
    assert ordered(db, "SELECT id FROM t ORDER BY val NULLS FIRST, id") == [(2,), (4,), (1,), (3,)]
    assert ordered(db, "SELECT id FROM t ORDER BY val DESC NULLS FIRST, id DESC") == [(4,), (2,), (3,), (1,)]


def test_natural_and_using(db):
    db.script("CREATE TABLE a (id INT, name TEXT, dept TEXT); CREATE TABLE b (id INT, age INT, dept TEXT)")
    db.sql("INSERT INTO a VALUES (1, 'alice', 'x'), (2, 'bob', 'y'), (3, 'eve', 'x')")
    db.sql("INSERT INTO b VALUES (1, 30, 'x'), (2, 25, 'z'), (3, 41, 'x')")
    assert rows(db, "SELECT name, age FROM a NATURAL JOIN b") == [("alice", 30), ("eve", 41)]
    assert rows(db, "SELECT name, age FROM a JOIN b USING (id, dept)") == [("alice", 30), ("eve", 41)]
    assert rows(db, "SELECT id, age FROM a LEFT JOIN b USING (id)") == [(1, 30), (2, 25), (3, 41)]


def test_views(db):
    db.script("CREATE TABLE t (id INT, val INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    db.sql("CREATE VIEW v AS SELECT * FROM t WHERE val > 15 WITH CHECK OPTION")
    assert rows(db, "SELECT id FROM v") == [(2,), (3,)]
    db.sql("INSERT INTO v VALUES (4, 40)")
    for text in ("INSERT INTO v VALUES (5, 5)", "UPDATE v SET val = 1 WHERE id = 2"):
        with pytest.raises(ConstraintError, match="leave the view"):
            db.sql(text)
    db.sql("UPDATE v SET val = val + 1")
    assert rows(db, "SELECT id, val FROM t") == [(1, 10), (2, 21), (3, 31), (4, 41)]
    db.sql("CREATE VIEW w AS SELECT id FROM v WHERE id < 4")
    assert rows(db, "SELECT * FROM w") == [(2,), (3,)]
    with pytest.raises(EngineError):
        db.sql("DROP TABLE t")
    db.sql("DROP TABLE t CASCADE")
    assert db.state["views"] == {}


def test_foreign_keys(db):
    db.sql("CREATE TABLE p (id INT PRIMARY KEY)")
    db.sql("CREATE TABLE c (id INT, p INT REFERENCES p(id) ON DELETE CASCADE)")
    db.sql("CREATE TABLE d (id INT, p INT, FOREIGN KEY (p) REFERENCES p ON DELETE SET NULL)")
    db.sql("CREATE TABLE e (id INT, p INT REFERENCES p(id))")
    db.script("INSERT INTO p VALUES (1), (2), (3); INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL); INSERT INTO d VALUES (1, 1); INSERT INTO e VALUES (1, 3)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO c VALUES (9, 9)")
    db.sql("DELETE FROM p WHERE id = 1")
    assert rows(db, "SELECT id FROM c") == [(2,), (3,)] and rows(db, "SELECT * FROM d") == [(1, None)]
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM p WHERE id = 3")
    with pytest.raises(ConstraintError):
        db.sql("UPDATE p SET id = 7 WHERE id = 3")


def test_merge_upsert_returning(db):
    db.script("CREATE TABLE t (k INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1), (2, 2)")
    out = db.sql("INSERT INTO t VALUES (2, 20), (3, 30) ON CONFLICT (k) DO UPDATE SET v = t.v + excluded.v RETURNING k, v")
    assert sorted(map(tuple, out.df.collect())) == [(2, 22), (3, 30)] and out.affected == 2
    db.sql("INSERT INTO t VALUES (3, 0), (4, 4) ON CONFLICT (k) DO NOTHING")
    assert rows(db, "SELECT * FROM t") == [(1, 1), (2, 22), (3, 30), (4, 4)]
    assert [tuple(r) for r in db.sql("UPDATE t SET v = 0 WHERE k = 1 RETURNING k, v AS w").df.collect()] == [(1, 0)]
    assert [tuple(r) for r in db.sql("DELETE FROM t WHERE k = 4 RETURNING *").df.collect()] == [(4, 4)]
    with pytest.raises(EngineError, match="twice"):
        db.sql("MERGE INTO t USING (SELECT 1 AS k UNION ALL SELECT 1) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = 9")
    assert rows(db, "SELECT changes() AS a, total_changes() > 5 AS b") == [(1, True)]


def test_domains_assertions_triggers_functions(db):
    db.sql("CREATE DOMAIN positive AS INT DEFAULT 1 CHECK (VALUE > 0)")
    db.script("CREATE TABLE t (a positive, b INT); CREATE TABLE log (n INT)")
    db.sql("CREATE TRIGGER g AFTER INSERT ON t 'INSERT INTO log SELECT count(*) FROM t'")
    db.sql("INSERT INTO t (b) VALUES (5)")
    assert rows(db, "SELECT * FROM t") == [(1, 5)] and rows(db, "SELECT * FROM log") == [(1,)]
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t VALUES (0, 1)")
    db.sql("CREATE ASSERTION few CHECK ((SELECT count(*) FROM t) < 3) INITIALLY DEFERRED")
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (2, 2), (3, 3), (4, 4)")
    with pytest.raises(ConstraintError, match="few"):
        db.sql("COMMIT")
    assert rows(db, "SELECT count(*) AS n FROM t") == [(1,)]
    db.sql("ALTER TABLE t DISABLE TRIGGER g")
    db.sql("INSERT INTO t VALUES (2, 2)")
    assert rows(db, "SELECT count(*) AS n FROM log") == [(1,)]
    db.sql("CREATE FUNCTION plus(a INT, b INT) RETURNS INT AS 'a + b * 2'")
    assert rows(db, "SELECT plus(a, b) AS c FROM t") == [(6,), (11,)]
    db.sql("CREATE INDEX i ON t (a DESC, b)")
    db.script("DROP INDEX i; DROP FUNCTION plus; DROP TRIGGER g; DROP ASSERTION few; CREATE SCHEMA IF NOT EXISTS s")


def test_alter(db):
    db.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); ALTER TABLE t ADD COLUMN b TEXT DEFAULT 'x'; ALTER TABLE t ALTER COLUMN a TYPE BIGINT")
    db.script("ALTER TABLE t RENAME COLUMN a TO c; ALTER TABLE t ADD CONSTRAINT pos CHECK (c > 0); ALTER TABLE t ALTER COLUMN b SET NOT NULL; ALTER TABLE t RENAME TO u")
    assert rows(db, "SELECT c, b FROM u") == [(1, "x")]
    for text in ("INSERT INTO u VALUES (0, 'y')", "INSERT INTO u VALUES (1, NULL)", "ALTER TABLE u ADD CONSTRAINT big CHECK (c > 5)"):
        with pytest.raises(ConstraintError):
            db.sql(text)
    db.script("ALTER TABLE u DROP CONSTRAINT pos; INSERT INTO u VALUES (0, 'y'); TRUNCATE TABLE u; DROP TABLE u")


def test_privileges(spark, tmp_path):
    owner = Engine(spark, str(tmp_path))
    owner.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); GRANT SELECT, INSERT ON TABLE t TO ann WITH GRANT OPTION")
    ann = Engine(spark, str(tmp_path), user="ann")
    assert rows(ann, "SELECT a FROM t") == [(1,)]
    ann.sql("GRANT SELECT ON t TO bob")
    bob = Engine(spark, str(tmp_path), user="bob")
    assert rows(bob, "SELECT a FROM t") == [(1,)]
    for text in ("INSERT INTO t VALUES (2)", "DELETE FROM t", "GRANT SELECT ON t TO eve"):
        with pytest.raises(PrivilegeError):
            bob.sql(text)
    owner = Engine(spark, str(tmp_path))
    with pytest.raises(PrivilegeError):
        owner.sql("REVOKE SELECT ON t FROM ann")
    owner.sql("REVOKE ALL ON t FROM ann CASCADE")
    assert owner.state["grants"] == []


def test_cursors_and_explain(db):
    db.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (3), (1), (2)")
    db.sql("DECLARE c CURSOR FOR SELECT a FROM t ORDER BY a")
    assert [r[0] for r in db.sql("FETCH 2 FROM c").df.collect()] == [1, 2]
    assert [r[0] for r in db.sql("FETCH 2 FROM c").df.collect()] == [3]
    db.sql("CLOSE c")
    with pytest.raises(SqlError):
        db.sql("FETCH 1 FROM c")
    assert "Physical Plan" in db.query("EXPLAIN SELECT a FROM t").first()["plan"]


def test_wal_and_log_records(db):
    from quarryline.sources.store import log_record, log_record_valid

    db.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    phases = [__import__("json").loads(db.store.files.read(f"wal/{n}"))["phase"] for n in db.store.files.names("wal")]
    assert phases == ["PREPARE", "COMMIT"] * 2
    good = log_record("x", [{"table": "t", "op": "UPDATE", "key": {"a": 1}, "pre_image": {"a": 1}, "post_image": {"a": 2}}], 5)
    assert log_record_valid(good) and not log_record_valid(good | {"at": 6})
    for op, pre, post in (("INSERT", {"a": 1}, {"a": 1}), ("DELETE", None, None), ("UPDATE", None, {"a": 1})):
        with pytest.raises(TransactionError):
            log_record("x", [{"table": "t", "op": op, "key": {}, "pre_image": pre, "post_image": post}], 5)


def test_python_functions(db):
    db.script("CREATE TABLE t (k INT, v DOUBLE); INSERT INTO t VALUES (1, 1), (1, 3), (2, 5)")
    db.register_function("twice", lambda v: v * 2, "DOUBLE")
    db.register_function("spread", lambda v: float(v.max() - v.min()), "DOUBLE", aggregate=True)
    assert rows(db, "SELECT twice(v) AS w FROM t") == [(2.0,), (6.0,), (10.0,)]
    assert rows(db, "SELECT k, spread(v) AS s FROM t GROUP BY k") == [(1, 2.0), (2, 0.0)]


def test_event_windows(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from quarryline.streaming.windows import sessions, windowed

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    day = windowed(events, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    want = events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, day.select("window_start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    assert windowed(events, "ts", "1 day", [], [F.count("*").alias("n")], slide="12 hours").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert sessions(events, "ts", "1 hour", ["user_id"], [F.count("*").alias("n")]).agg(F.sum("n")).first()[0] == events.count()
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows_out").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {tuple(r) for r in spark.table("windows_out").select("window_start", "event_type", "n").collect()}
    assert closed and closed <= {tuple(r) for r in want.collect()}
