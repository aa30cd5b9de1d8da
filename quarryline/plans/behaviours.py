"""Queries of statements, constraints, privileges, sessions and sources, with their DuckDB SQL.

Each works on a copy of all orders (table t). `refused` counts the statements that must fail; what they would
have done must not show in the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import T, log_schema, orders_log, query, sql, store, table


def refusals(engine, tries: list[str]) -> int:
    """How many statements fail."""
    n = 0
    for text in tries:
        try:
            out = engine.sql(text)
            if out.df is not None:
                out.df.collect()
        except Exception:
            n += 1
    return n


def kept(name: str, statements: str, tries: list[str], select: str, oracle: str) -> None:
    """Runs statements, then tries that must all fail, and selects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = store(spark, sf_dir)
        engine.register("customer", table(spark, sf_dir, "customer"))
        engine.script(statements)
        n = refusals(engine, tries)
        out = engine.query(select)
        return out.withColumn("refused", F.lit(n)) if tries else out

    refused = f", {len(tries)} AS refused" if tries else ""
    query(name, f"WITH t AS ({T}) SELECT *{refused} FROM ({oracle})")(run)


ROWS = "SELECT k, c, s, p FROM t"
PARENT = "CREATE TABLE cu (id BIGINT PRIMARY KEY, n VARCHAR(40)); INSERT INTO cu SELECT c_custkey, c_name FROM customer"


def children(actions: str, default: str = "") -> str:
    return f"{PARENT}; CREATE TABLE o (k BIGINT, c BIGINT{default} REFERENCES cu {actions}); INSERT INTO o SELECT k, c FROM t"


CHANGE, REMOVE = "UPDATE cu SET id = id + 1000000 WHERE id % 7 = 0", "DELETE FROM cu WHERE id % 5 = 0"

# constraints

kept("pk_refuses", "DELETE FROM t WHERE s = 'P'", ["INSERT INTO t SELECT max(k), 1, 'X', 1 FROM t", "INSERT INTO t VALUES (NULL, 1, 'X', 1)", "UPDATE t SET k = 1"], ROWS, "SELECT * FROM t WHERE s <> 'P'")
kept("check_refuses", "ALTER TABLE t ADD CONSTRAINT known CHECK (s IN ('F', 'O', 'P'))", ["UPDATE t SET p = 0 - p", "INSERT INTO t VALUES (-5, 1, 'F', -1)", "UPDATE t SET s = 'Q' WHERE c % 2 = 0"], ROWS, "SELECT * FROM t")
kept("unique_with_nulls", "CREATE TABLE u (k BIGINT UNIQUE); INSERT INTO u SELECT CASE WHEN k % 2 = 0 THEN k END FROM t", ["INSERT INTO u SELECT max(k) FROM u"], "SELECT k FROM u", "SELECT CASE WHEN k % 2 = 0 THEN k END AS k FROM t")
kept("not_null_default", "CREATE TABLE u (k BIGINT NOT NULL, d VARCHAR(3) DEFAULT 'abc'); INSERT INTO u (k) SELECT k FROM t", ["INSERT INTO u VALUES (NULL, 'x')", "UPDATE u SET k = NULL"], "SELECT k, d FROM u", "SELECT k, 'abc' AS d FROM t")
kept("fk_update_cascade", f"{children('ON UPDATE CASCADE ON DELETE CASCADE')}; {CHANGE}; {REMOVE}", [], "SELECT k, c FROM o", "SELECT k, c FROM (SELECT k, CASE WHEN c % 7 = 0 THEN c + 1000000 ELSE c END AS c FROM t) WHERE c % 5 <> 0")
kept("fk_set_null", f"{children('ON UPDATE SET NULL ON DELETE SET NULL')}; {CHANGE}; {REMOVE}", [], "SELECT k, c FROM o", "SELECT k, CASE WHEN c % 7 <> 0 AND c % 5 <> 0 THEN c END AS c FROM t")
kept("fk_set_default", f"{children('ON UPDATE SET DEFAULT ON DELETE SET DEFAULT', ' DEFAULT 1')}; {CHANGE}; {REMOVE}", [], "SELECT k, c FROM o", "SELECT k, CASE WHEN c % 7 <> 0 AND c % 5 <> 0 THEN c ELSE 1 END AS c FROM t")
kept("fk_restrict", children("ON UPDATE RESTRICT"), [CHANGE, REMOVE, "INSERT INTO o VALUES (-1, -1)", "UPDATE o SET c = -1", "DROP TABLE cu"], "SELECT o.k, o.c, cu.id FROM o JOIN cu ON cu.id = o.c", "SELECT k, c, c AS id FROM t")
kept(
    "fk_chain", f"{children('ON UPDATE CASCADE')}; CREATE TABLE a (x BIGINT PRIMARY KEY); INSERT INTO a SELECT DISTINCT c FROM t; CREATE TABLE b (x BIGINT PRIMARY KEY REFERENCES a ON UPDATE CASCADE); INSERT INTO b SELECT x FROM a; CREATE TABLE d (x BIGINT REFERENCES b ON UPDATE SET NULL); INSERT INTO d SELECT c FROM t; UPDATE a SET x = 0 - x WHERE x % 2 = 0",
    [], "SELECT (SELECT sum(x) FROM b) AS sb, x FROM d", "SELECT (SELECT CAST(sum(CASE WHEN c % 2 = 0 THEN -c ELSE c END) AS BIGINT) FROM (SELECT DISTINCT c FROM t)) AS sb, CASE WHEN c % 2 <> 0 OR c = 0 THEN c END AS x FROM t",
)
PAIRS = "CREATE TABLE p2 (a INT, b INT, PRIMARY KEY (a, b)); INSERT INTO p2 VALUES (1, 1), (2, 2); CREATE TABLE c2 (x INT, y INT, FOREIGN KEY (x, y) REFERENCES p2 {}); INSERT INTO c2 VALUES (1, 1), (NULL, NULL)"
kept("fk_match_partial", PAIRS.format("MATCH PARTIAL") + "; INSERT INTO c2 VALUES (1, NULL), (NULL, 2)", ["INSERT INTO c2 VALUES (3, NULL)", "INSERT INTO c2 VALUES (NULL, 9)", "INSERT INTO c2 VALUES (1, 2)"], "SELECT x, y FROM c2", "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (VALUES (1, 1), (NULL, NULL), (1, NULL), (NULL, 2)) v(x, y)")
kept("fk_match_full", PAIRS.format("MATCH FULL"), ["INSERT INTO c2 VALUES (1, NULL)", "INSERT INTO c2 VALUES (3, 3)"], "SELECT x, y FROM c2", "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (VALUES (1, 1), (NULL, NULL)) v(x, y)")
kept("domain", "CREATE DOMAIN price AS DOUBLE DEFAULT 2 CHECK (VALUE >= 0); CREATE TABLE u (k BIGINT, p price); INSERT INTO u SELECT k, p FROM t; INSERT INTO u (k) VALUES (-1)", ["INSERT INTO u VALUES (1, -1)", "UPDATE u SET p = 0 - p"], "SELECT k, p FROM u", "SELECT k, p FROM t UNION ALL SELECT -1, 2")
kept("assertion", "CREATE ASSERTION fair CHECK ((SELECT count(*) FROM t WHERE p < 0.5) = 0)", ["UPDATE t SET p = 0.1 WHERE k % 10 = 0", "CREATE ASSERTION none CHECK ((SELECT count(*) FROM t) = 0)"], ROWS, "SELECT * FROM t")
kept("trigger", "CREATE TABLE log (n BIGINT); CREATE TRIGGER g AFTER DELETE ON t 'INSERT INTO log SELECT count(*) FROM t'; DELETE FROM t WHERE s = 'F'; ALTER TABLE t DISABLE TRIGGER g; DELETE FROM t WHERE s = 'O'; ALTER TABLE t ENABLE TRIGGER g; DELETE FROM t", [], "SELECT n FROM log", "SELECT count(*) AS n FROM t WHERE s <> 'F' UNION ALL SELECT 0")

# definitions

kept("ctas", "CREATE TABLE u AS SELECT c, count(*) AS n FROM t GROUP BY c", [], "SELECT c, n FROM u", "SELECT c, count(*) AS n FROM t GROUP BY c")
kept("drop_table", "CREATE TABLE u (a INT); DROP TABLE u; DROP TABLE IF EXISTS u", ["SELECT * FROM u", "DROP TABLE u"], ROWS, "SELECT * FROM t")
kept("truncate", "CREATE TABLE u AS SELECT * FROM t; TRUNCATE TABLE t; INSERT INTO t SELECT k, c, s, p FROM u WHERE s = 'F'", [], ROWS, "SELECT * FROM t WHERE s = 'F'")
kept("schema_and_index", "CREATE SCHEMA s1; CREATE SCHEMA IF NOT EXISTS s1; CREATE UNIQUE INDEX ix ON t (k); CREATE INDEX iy ON t (c DESC, s)", ["CREATE SCHEMA s1", "CREATE UNIQUE INDEX iz ON t (c)", "CREATE INDEX iy ON t (c)"], ROWS, "SELECT * FROM t")
kept(
    "alter_types", "ALTER TABLE t ALTER COLUMN c TYPE VARCHAR(20); ALTER TABLE t ALTER COLUMN s SET DEFAULT 'D'; INSERT INTO t (k, p) VALUES (-1, 3); ALTER TABLE t ALTER COLUMN s DROP DEFAULT; INSERT INTO t (k, p) VALUES (-2, 3); ALTER TABLE t ADD CONSTRAINT big CHECK (k > -10); ALTER TABLE t DISABLE CONSTRAINT big; ALTER TABLE t ENABLE CONSTRAINT big",
    ["INSERT INTO t (k, p) VALUES (-11, 1)", "ALTER TABLE t ALTER COLUMN s SET NOT NULL", "ALTER TABLE t ADD CONSTRAINT more CHECK (k > 0)"], ROWS, "SELECT k, CAST(c AS VARCHAR) AS c, s, p FROM t UNION ALL SELECT -1, NULL, 'D', 3 UNION ALL SELECT -2, NULL, NULL, 3",
)
kept(
    "rename_follows", f"{children('ON UPDATE CASCADE')}; ALTER TABLE cu RENAME TO people; ALTER TABLE people RENAME COLUMN id TO pid; ALTER TABLE t RENAME COLUMN p TO price; INSERT INTO t VALUES (-1, 1, 'N', 5); UPDATE people SET pid = pid + 1000000 WHERE pid % 7 = 0",
    ["INSERT INTO t VALUES (-2, 1, 'N', -5)", "INSERT INTO o VALUES (1, -1)"], "SELECT t.k, t.price, o.c FROM t LEFT JOIN o ON o.k = t.k", "SELECT k, p AS price, CASE WHEN c % 7 = 0 THEN c + 1000000 ELSE c END AS c FROM t UNION ALL SELECT -1, 5, NULL",
)
kept("drop_column_follows", "CREATE TABLE u (k BIGINT, q DOUBLE CHECK (q > 0), CHECK (k > -5)); INSERT INTO u SELECT k, p FROM t; ALTER TABLE u DROP COLUMN q; INSERT INTO u VALUES (7)", ["INSERT INTO u VALUES (-7)"], "SELECT k FROM u", "SELECT k FROM t UNION ALL SELECT 7")
kept("views_are_kept", "CREATE VIEW v AS SELECT k, p FROM t WHERE p > 1000; CREATE VIEW w AS SELECT k FROM v", ["DROP VIEW v", "ALTER TABLE t RENAME COLUMN p TO q", "ALTER TABLE t RENAME TO z", "DROP TABLE t"], "SELECT k FROM w", "SELECT k FROM t WHERE p > 1000")
kept("view_cascade", "CREATE VIEW v AS SELECT k, p FROM t; CREATE VIEW w AS SELECT k FROM v; DROP VIEW v CASCADE", ["SELECT * FROM w", "SELECT * FROM v"], ROWS, "SELECT * FROM t")
kept("view_local_check", "CREATE VIEW v AS SELECT * FROM t WHERE p > 1000 WITH CHECK OPTION", ["INSERT INTO v VALUES (-1, 1, 'N', 5)", "UPDATE v SET p = 5"], ROWS, "SELECT * FROM t")
kept("sql_function", "CREATE FUNCTION twice(x DOUBLE) RETURNS DOUBLE AS 'x * 2'", ["CREATE FUNCTION f(x INT) RETURNS INT AS 'BEGIN RETURN x; END'"], "SELECT k, twice(p) AS q FROM t", "SELECT k, p * 2 AS q FROM t")


kept(
    "table_function", "CREATE FUNCTION dear(least DOUBLE) RETURNS TABLE (k BIGINT, q DOUBLE) AS 'SELECT k, p * 2 FROM t WHERE p > least'; CREATE FUNCTION next(x BIGINT) RETURNS TABLE (y BIGINT) AS 'SELECT x + 1'; DELETE FROM t WHERE s = 'F'",
    ["SELECT * FROM dear()", "CREATE FUNCTION bad(x INT) RETURNS TABLE (a INT) AS 'SELECT 1, 2'", "DROP FUNCTION missing"], "SELECT d.k, d.q, n.y FROM dear(1000) AS d, LATERAL next(d.k) AS n", "SELECT k, p * 2 AS q, k + 1 AS y FROM t WHERE s <> 'F' AND p > 1000",
)


@query("function_returns", f"SELECT k, p * 2 AS q FROM ({T})")
def function_returns(spark, sf_dir):
    from ..engine import Engine

    engine = store(spark, sf_dir)
    engine.sql("CREATE FUNCTION doubled(x DOUBLE) RETURNS DOUBLE AS 'x * 2'")
    return Engine(spark, engine.store.root).query("SELECT k, doubled(p) AS q FROM t")


@query("privileges", f"SELECT k, p * 2 AS q, 6 AS refused FROM ({T})")
def privileges(spark, sf_dir):
    from ..engine import Engine

    owner = store(spark, sf_dir)
    owner.script("CREATE FUNCTION half(x DOUBLE) RETURNS DOUBLE AS 'x / 2'; CREATE FUNCTION more(x DOUBLE) RETURNS DOUBLE AS 'x * 2'")
    owner.script("GRANT SELECT ON TABLE t TO ann WITH GRANT OPTION; GRANT EXECUTE ON FUNCTION more TO ann; GRANT UPDATE ON TABLE t TO ann; REVOKE UPDATE ON TABLE t FROM ann")
    user = lambda name: Engine(spark, owner.store.root, user=name)
    ann = user("ann")
    n = refusals(ann, ["SELECT half(p) FROM t", "INSERT INTO t VALUES (-1, 1, 'N', 1)", "DELETE FROM t", "UPDATE t SET p = 1", "GRANT DELETE ON TABLE u TO bob"])
    n += refusals(user("bob"), ["SELECT k FROM t"])
    return ann.query("SELECT k, more(p) AS q FROM t").withColumn("refused", F.lit(n))


@query("returning", f"SELECT k, p + 1 AS q, s FROM ({T}) WHERE s = 'F'")
def returning(spark, sf_dir):
    return store(spark, sf_dir).query("UPDATE t SET p = p + 1 WHERE s = 'F' RETURNING k, p AS q, s")


@query("insert_values_many", f"SELECT * FROM ({T}) UNION ALL SELECT -i, i % 7, 'N', i / 2 FROM range(1, 1001) r(i)")
def insert_values_many(spark, sf_dir):
    engine = store(spark, sf_dir)
    engine.sql(f"INSERT INTO t VALUES {', '.join(f'(-{i}, {i % 7}, DEFAULT, {i / 2})' for i in range(1, 1001))}")
    return engine.query(ROWS)


@query("cursor", f"SELECT k FROM ({T}) ORDER BY k LIMIT 3 OFFSET 4")
def cursor(spark, sf_dir):
    engine = store(spark, sf_dir)
    engine.script("DECLARE c CURSOR FOR SELECT k FROM t ORDER BY k; FETCH 4 FROM c")
    out = engine.query("FETCH 3 FROM c")
    engine.sql("CLOSE c")
    return out


@query("counters", f"SELECT count(*) AS changed, (SELECT count(*) FROM ({T})) + count(*) AS total, (SELECT count(*) FROM ({T})) AS last_id FROM ({T}) WHERE s = 'F'")
def counters(spark, sf_dir):
    engine = store(spark, sf_dir)
    engine.sql("UPDATE t SET p = p + 1 WHERE s = 'F'")
    return engine.query("SELECT CAST(changes() AS BIGINT) AS changed, CAST(total_changes() AS BIGINT) AS total, CAST(last_insert_rowid() AS BIGINT) AS last_id")


@query("explain", "SELECT true AS has_scan, true AS has_query")
def explain(spark, sf_dir):
    out = store(spark, sf_dir).query("EXPLAIN SELECT k FROM t WHERE k > 5")
    return out.select(F.contains("plan", F.lit("Scan parquet")).alias("has_scan"), (F.length("query") > 0).alias("has_query"))


@query("isolation", f"SELECT level, seen, after, committed FROM (SELECT (SELECT count(*) FROM ({T})) AS n, (SELECT count(*) FROM ({T}) WHERE s <> 'F') AS left_, 1 AS one) x, (VALUES ('READ COMMITTED', 1, 1, true), ('REPEATABLE READ', 0, 1, true), ('SERIALIZABLE', 0, 0, false)) v(level, a, b, committed), LATERAL (SELECT CASE a WHEN 1 THEN left_ ELSE n END AS seen, left_ AS after) y")
def isolation(spark, sf_dir):
    """Under each level: the rows of t that a transaction sees after another session has removed some, the rows
    after it, and whether it could commit what it wrote to another table."""
    from ..engine import Engine
    from ..errors import ConflictError

    out = []
    for level in ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
        one = store(spark, sf_dir)
        one.sql("CREATE TABLE u (a INT)")
        two = Engine(spark, one.store.root)
        one.script(f"BEGIN ISOLATION LEVEL {level}; INSERT INTO u VALUES (1)")
        two.sql("DELETE FROM t WHERE s = 'F'")
        seen = one.query("SELECT count(*) AS n FROM t").first()["n"]
        try:
            one.sql("COMMIT")
            committed = True
        except ConflictError:
            one.sql("ROLLBACK")
            committed = False
        out.append((level, seen, one.query("SELECT count(*) AS n FROM t").first()["n"], committed))
    return spark.createDataFrame(out, "level string, seen long, after long, committed boolean")


@query("txn_modes", f"SELECT 3 AS refused, (SELECT count(*) FROM ({T})) AS n")
def txn_modes(spark, sf_dir):
    """A transaction that only reads refuses writes; one that has run out of time is rolled back."""
    from dataclasses import replace
    from time import sleep

    engine = store(spark, sf_dir)
    engine.script("SET TRANSACTION READ ONLY; BEGIN")
    n = refusals(engine, ["DELETE FROM t", "SET TRANSACTION ISOLATION LEVEL SERIALIZABLE"])
    engine.sql("COMMIT")
    engine.config = replace(engine.config, transaction_timeout_ms=1)
    engine.sql("BEGIN")
    sleep(0.01)
    n += refusals(engine, ["DELETE FROM t"])
    return engine.query(f"SELECT {n} AS refused, count(*) AS n FROM t")


@query("wal", "SELECT 'PREPARE,COMMIT,PREPARE,COMMIT,PREPARE,COMMIT' AS phases, true AS valid")
def wal(spark, sf_dir):
    import json

    from ..sources.store import log_record_valid

    engine = store(spark, sf_dir)
    engine.script("BEGIN; DELETE FROM t WHERE s = 'F'; DELETE FROM t WHERE s = 'O'; COMMIT")
    logged = [json.loads(engine.store.files.read(f"wal/{name}")) for name in sorted(engine.store.files.names("wal"))]
    return spark.createDataFrame([(",".join(x["phase"] for x in logged), all(log_record_valid(x["record"]) for x in logged))], "phases string, valid boolean")


@query("limiters", "SELECT 4 AS refused")
def limiters(spark, sf_dir):
    engine = store(spark, sf_dir)
    n = refusals(engine, ["SELECT k FROM t LIMIT 1 FETCH FIRST 1 ROWS ONLY", "SELECT TOP 1 k FROM t LIMIT 1", "SELECT k FROM t LIMIT -1", "SELECT k FROM t FETCH FIRST 2 ROWS ONLY LIMIT 3"])
    return spark.createDataFrame([(n,)], "refused int")


# functions

sql("fn_names", "SELECT p_partkey, ceiling(p_retailprice) AS a, pow(p_size, 2) AS b, char_length(p_name) AS c, character_length(p_name) AS d, ucase(p_name) AS e, json('{ \"a\" : 1 }') AS f FROM part", "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS a, pow(p_size, 2) AS b, CAST(length(p_name) AS INTEGER) AS c, CAST(length(p_name) AS INTEGER) AS d, upper(p_name) AS e, '{ \"a\" : 1 }' AS f FROM part")
sql("fn_now", "SELECT r_regionkey, now() IS NULL AS a, current_timestamp IS NULL AS b, current_date IS NULL AS c, current_time IS NULL AS d, random() BETWEEN -9223372036854775807 AND 9223372036854775807 AS e FROM region", "SELECT r_regionkey, false AS a, false AS b, false AS c, false AS d, true AS e FROM region")
sql("fn_session", "SELECT r_regionkey, changes() AS a, total_changes() AS b, last_insert_rowid() AS c, txn_current() AS d, txn_difference() AS e, rowid() AS f, oid() AS g, sqlite_version() AS h, sqlite_source_id() AS i FROM region", "SELECT r_regionkey, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS g, '3.45.0' AS h, '2024-01-15 00:00:00' AS i FROM region")
sql("approx_count", "SELECT o_orderstatus, approx_count_distinct(o_orderpriority) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderstatus")
WINDOW = "PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
sql(
    "win_exclude_peers",
    f"SELECT o_orderkey, count(o_totalprice) OVER ({WINDOW} EXCLUDE GROUP) AS a, round(sum(o_totalprice) OVER ({WINDOW} EXCLUDE TIES), 2) AS b, max(o_totalprice) OVER ({WINDOW} EXCLUDE GROUP) AS c, count(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS d FROM orders",
)


@query("python_functions", "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, round(sum(o_totalprice * 2), 0) AS twice FROM orders GROUP BY o_orderstatus")
def python_functions(spark, sf_dir):
    engine = store(spark, sf_dir)
    engine.register_function("py_twice", lambda x: x * 2, "DOUBLE")
    engine.register_function("py_spread", lambda x: float(x.max() - x.min()), "DOUBLE", aggregate=True)
    spread = engine.query("SELECT s AS o_orderstatus, round(py_spread(p), 2) AS spread FROM t GROUP BY s")
    return spread.join(engine.query("SELECT s AS o_orderstatus, round(sum(py_twice(p)), 0) AS twice FROM t GROUP BY s"), "o_orderstatus")


# change log, pages, locks, batches


@query("log_stream_tampered", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey < (SELECT quantile_disc(o_orderkey, 0.5) FROM orders)")
def log_stream_tampered(spark, sf_dir):
    """A stream whose record of the middle order was changed: it and all that link to it are left out."""
    from ..operators.ranking import shared_folder
    from ..streaming.replay import LogReplay

    log = orders_log(spark, sf_dir, chains=1, changes=False)
    middle = table(spark, sf_dir, "orders").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey)").cast("long").alias("m")).first()["m"]
    mine = F.contains("row_json", F.lit(f'"k":{middle},'))
    log = log.withColumn("row_json", F.when(mine, F.replace("row_json", F.lit('"s":"'), F.lit('"s":"#'))).otherwise(F.col("row_json")))
    log = log.withColumn("payload_text", F.when(mine, F.replace("payload_text", F.lit('"v":1'), F.lit('"v":2'))).otherwise(F.col("payload_text")))
    root = shared_folder(log)
    log.write.parquet(f"{root}/log")
    return LogReplay(spark, f"{root}/log", "o0", log_schema(), "k", f"{root}/out").run(f"{root}/checkpoint")


@query("log_tables", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 16 = 3")
def log_tables(spark, sf_dir):
    """Only one of the log's tables is resolved and read."""
    from ..operators.ranking import shared_folder
    from ..sources import changelog

    log = orders_log(spark, sf_dir)
    root = shared_folder(log)
    log.write.partitionBy("table_id").parquet(f"{root}/log")
    return changelog.replay(changelog.verify(changelog.read_log(spark, f"{root}/log", ["o3"])).filter("accepted"), log_schema(), "k")


@query("log_writer", "SELECT * FROM (VALUES (1, 'x''y', 2.5::DOUBLE), (2, NULL, 3.0::DOUBLE)) v(id, name, price)")
def log_writer(spark, sf_dir):
    """Statements written as chained records, read back and replayed."""
    from pyspark.sql.types import StructType

    from ..operators.ranking import shared_folder
    from ..sources import changelog

    writer, root = changelog.LogWriter(clock=lambda: 1), shared_folder(table(spark, sf_dir, "region"))
    writer.append(spark, f"{root}/log", ["INSERT INTO t (id, name, price) VALUES (1, 'x''y', 2.5)", "INSERT INTO t (id, name, price) VALUES (2, NULL, 9)", "INSERT INTO t (id, name, price) VALUES (3, 'gone', 1)"])
    writer.append(spark, f"{root}/log", ["UPDATE t SET price = 3 WHERE id = 2", "DELETE FROM t WHERE id = 3"])
    schema = StructType().add("id", "integer").add("name", "string").add("price", "double")
    return changelog.replay(changelog.verify(changelog.read_log(spark, f"{root}/log"), strict=True).filter("accepted"), schema, "id")


@query("page_rechunk", "SELECT count(*) // 500 + CAST(count(*) % 500 > 0 AS INTEGER) AS pages, count(*) AS n, true AS same FROM orders")
def page_rechunk(spark, sf_dir):
    """Pages after rows came are those of all rows together."""
    from ..sources.pages import page_manifest, rechunk

    rows = table(spark, sf_dir, "orders")
    again = rechunk(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 <> 0"), F.col("o_orderkey"), table="orders")
    whole = page_manifest(rows, "orders", F.col("o_orderkey")).select("page_index", F.col("key_merkle_root").alias("root"))
    return again.join(whole, "page_index").agg(F.count("*").alias("pages"), F.sum("row_count").alias("n"), F.min(F.col("root") == F.col("key_merkle_root")).alias("same"))


@query("read_estimate", "SELECT * FROM (VALUES ('point', 1), ('indexed', 2), ('range', 6), ('full_scan', 20)) v(kind, pages)")
def read_estimate(spark, sf_dir):
    from ..sources.pages import pages_to_read

    return spark.createDataFrame([(k, pages_to_read(20, k)) for k in ("point", "indexed", "range", "full_scan")], "kind string, pages int")


@query("row_versions", "SELECT r_regionkey, sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS version FROM region")
def row_versions(spark, sf_dir):
    from ..operators.merge import row_version

    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return rows.select("r_regionkey", row_version(rows).alias("version"))


@query("optimistic_lock", "SELECT 'v1' AS expected, 'v2' AS found, 2 AS row_version, 1 AS conflicts")
def optimistic_lock(spark, sf_dir):
    from ..errors import ConflictError
    from ..sources.lock import LockManager

    lock, conflicts = LockManager(), 0
    lock.record_read("t", "1", "v1")
    seen = lock.conflict("t", "1", "v2").details
    lock.confirm("t", "1", "v2", "me")
    one = store(spark, sf_dir)
    from ..engine import Engine

    two = Engine(spark, one.store.root)
    one.sql("DELETE FROM t WHERE s = 'F'")
    try:
        two.sql("DELETE FROM t WHERE s = 'O'")
    except ConflictError:
        conflicts = 1
    return spark.createDataFrame([(seen["expected"], seen["actual"], lock.local("t", "1").row_version, conflicts)], "expected string, found string, row_version int, conflicts int")


@query("batches", "SELECT '3,1,2' AS sizes, 0 AS waiting")
def batches(spark, sf_dir):
    from ..config import BatchConfig
    from ..sources.batch import BatchCommitter

    done, now = [], [0.0]
    batch = BatchCommitter(lambda ops: done.append(len(ops)), BatchConfig(200, 3, 100), clock=lambda: now[0])
    for op in "abcd":
        batch.enqueue(op)
    now[0] = 1.0
    batch.tick()  # late
    batch.enqueue("e")
    batch.enqueue("many", rows=100)
    return spark.createDataFrame([(",".join(map(str, done)), batch.size)], "sizes string, waiting int")


@query("cells", "SELECT * FROM (VALUES (1, '2.5', 'x', true), (2, NULL, '', false)) v(i, d, s, b)")
def cells(spark, sf_dir):
    """Values of all kinds through a table's files and back."""
    engine = store(spark, sf_dir)
    engine.script("CREATE TABLE u (i INT, d DECIMAL(5, 1), s TEXT, b BOOLEAN); INSERT INTO u VALUES (1, 2.5, 'x', TRUE), (2, NULL, '', FALSE)")
    return engine.query("SELECT i, CAST(d AS VARCHAR(9)) AS d, s, b FROM u")


@query("errors", "SELECT * FROM (VALUES (1, 'SELECT FROM'), (2, 'DELETE t WHERE'), (3, 'INSERT INTO missing VALUES (1)')) v(k, text)")
def errors(spark, sf_dir):
    """Texts that raise errors of the engine's own kinds."""
    from ..errors import EngineError

    engine, out = store(spark, sf_dir), []
    for k, text in enumerate(["SELECT FROM", "DELETE t WHERE", "INSERT INTO missing VALUES (1)"], 1):
        try:
            engine.sql(text)
        except EngineError:
            out.append((k, text))
    return spark.createDataFrame(out, "k int, text string")


@query("settings", "SELECT 'mysql' AS dialect, 250 AS page_size, 7 AS max_ops, true AS strict")
def settings(spark, sf_dir):
    from ..config import load_config

    c = load_config({"QUARRYLINE_DIALECT": "mysql", "QUARRYLINE_BATCH_MAX_OPS": "7", "QUARRYLINE_STRICT_CHAIN": "true"}, page_size=250)
    return spark.createDataFrame([(c.dialect, c.page_size, c.batch.max_ops, c.strict_chain)], "dialect string, page_size int, max_ops int, strict boolean")


@query("dml_cost", "SELECT true AS dearer, true AS allowed")
def dml_cost(spark, sf_dir):
    from ..sources.cost import check_threshold, estimate_dml

    one, many = estimate_dml("DELETE FROM t WHERE a = 1", 1, 1), estimate_dml("DELETE FROM t WHERE a = 1", 10, 1)
    return spark.createDataFrame([(many.gas > one.gas, not check_threshold(one)[0])], "dearer boolean, allowed boolean")


@query("function_registry", "SELECT true AS scalar, true AS aggregate, true AS win, false AS unknown")
def function_registry(spark, sf_dir):
    from ..functions.registry import get_registered_functions, is_registered_function

    kinds = [bool(get_registered_functions(k)) for k in ("scalar", "aggregate", "window")]
    return spark.createDataFrame([(*kinds, is_registered_function("NO_SUCH_NAME"))], "scalar boolean, aggregate boolean, win boolean, unknown boolean")
