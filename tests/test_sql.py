"""The translator, dialects, functions and the other modules on small inputs."""

import json

import pytest

from quarryline.config import BatchConfig, load_config
from quarryline.errors import EngineError
from quarryline.functions import call, get_registered_functions, is_registered_function
from quarryline.functions import json as json_functions
from quarryline.sources import changelog, cost, pages
from quarryline.sources.batch import BatchCommitter
from quarryline.sources.lock import LockManager
from quarryline.sql import translate
from quarryline.types import parse_type


def one(spark, text, dialect="ansi"):
    json_functions.register(spark)
    return spark.sql(translate(text, dialect)).first()[0]


@pytest.mark.parametrize(
    "text,value",
    [
        ("SELECT 1 / 0", None), ("SELECT 7 / 2", 3.5), ("SELECT 7 % 0", None), ("SELECT 2147483647 + 1", None), ("SELECT 1 + 2 * 3 - 4", 3), ("SELECT -(-3)", 3), ("SELECT - -3", 3),
        ("SELECT 'a' || 'b' || NULL", None), ("SELECT NOT 1 = 2 AND 3 < 4", True), ("SELECT 1 IS 1", True), ("SELECT NULL IS NOT 1", True), ("SELECT 5 BETWEEN 1 AND 5", True),
        ("SELECT 'ABC' LIKE 'a%'", True), ("SELECT 'a_c' LIKE 'a!_c' ESCAPE '!'", True), ("SELECT 'abc' LIKE 'a!_c' ESCAPE '!'", False), ("SELECT 3 IN (1, NULL)", None), ("SELECT 3 IN ()", False),
        ("SELECT CASE WHEN 1 > 2 THEN 'x' END", None), ("SELECT CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END", "b"), ("SELECT 'it''s'", "it's"), ("SELECT 'a\\nb'", "a\\nb"),
        ("SELECT 'X' COLLATE NOCASE = 'x'", True), ("SELECT 6 & 3 | 8 ^ 1", 11), ("SELECT ~5", -6), ("SELECT 1 << 4 >> 1", 8), ("SELECT coalesce(NULL, 2)", 2), ("SELECT nullif(3, 3)", None),
        ("SELECT round(2.5)", 3), ("SELECT round(-2.567, 2)", -2.57), ("SELECT trunc(-2.567, 1)", -2.5), ("SELECT sqrt(-1)", None), ("SELECT log(8, 2)", 3.0), ("SELECT substr('hello', 2, 3)", "ell"),
        ("SELECT substr('hello', -3)", "llo"), ("SELECT instr('Hello', 'L')", 3), ("SELECT trim('x' FROM 'xaxx')", "a"), ("SELECT substring('hello' FROM 2 FOR 2)", "el"),
        ("SELECT concat('a', NULL, 1)", "a1"), ("SELECT concat_ws('-', 'a', NULL, 'b')", "a--b"), ("SELECT right('abc', 0)", ""), ("SELECT quote('it''s')", "'it''s'"), ("SELECT glob('abc.txt', 'a*.t?t')", True),
        ("SELECT glob('abc', '[!b]bc')", True), ("SELECT regexp_replace('a', 'banana', 'o', 2)", "bonona"), ("SELECT regexp_replace('a', 'banana', 'o', 0)", "banana"), ("SELECT regexp_extract('(b)(c)', 'aBC', 2)", "C"),
        ("SELECT regexp_like('ABC', 'b', 'c')", False), ("SELECT CAST('3.9' AS INT)", 3), ("SELECT CAST('abc' AS INT)", None), ("SELECT CAST('x' AS VARCHAR(3))", "x"), ("SELECT CAST('long' AS VARCHAR(3))", None),
        ("SELECT CAST('ab' AS CHAR(4))", "ab  "), ("SELECT CAST('25:00:00' AS TIME)", None), ("SELECT CAST('yes' AS BOOLEAN)", None), ("SELECT typeof(1.5E0)", "real"), ("SELECT hex('A')", "41"),
        ("SELECT strftime('%Y-%m', '2024-03-15')", "2024-03"), ("SELECT date('2024-01-31', '+1 month')", "2024-02-29"), ("SELECT julianday('2000-01-01 12:00:00')", 2451545.0), ("SELECT date(2451545)", "2000-01-01"),
        ("SELECT json_extract('{\"a\":{\"b\":[5,6]}}', '$.a.b[1]')", "6"), ("SELECT json_extract('{\"a\":\"s\"}', '$.a')", '"s"'), ("SELECT json_type('{\"a\":1}', '$.a')", "integer"), ("SELECT json_valid('nope')", 0),
        ("SELECT json_length('[1,2]')", 2), ("SELECT json_array(1, 'a', NULL)", '[1,"a",null]'), ("SELECT json_set('{\"a\":1}', '$.b', 2)", '{"a":1,"b":2}'), ("SELECT json_insert('{\"a\":1}', '$.a', 2)", '{"a":1}'),
        ("SELECT json_remove('{\"a\":1,\"b\":[1,2]}', '$.b[0]')", '{"a":1,"b":[2]}'), ("SELECT json_contains('{\"a\":[1,2]}', '{\"a\":[2]}')", 1), ("SELECT json('{\"a\":1}')", '{"a":1}'), ("SELECT json_keys('{\"a\":1,\"b\":2}')", '["a","b"]'),
        ("SELECT char(72, 105)", "Hi"), ("SELECT total(x) FROM (VALUES (NULL)) AS t(x)", 0.0), ("SELECT group_concat(x, ';') FROM (VALUES ('b'), ('a')) AS t(x)", "a;b"), ("SELECT sqlite_version()", "3.45.0"),
        ("SELECT 1 = ANY (VALUES (1), (2))", True), ("SELECT 3 = ANY (SELECT x FROM (VALUES (1), (NULL)) AS t(x))", None), ("SELECT 3 <> ALL (SELECT x FROM (VALUES (1), (2)) AS t(x))", True), ("SELECT 3 > ALL (SELECT 1 WHERE 1 = 2)", True),
    ],
)
def test_values(spark, text, value):
    got = one(spark, text)
    assert (float(got) == pytest.approx(float(value)) if isinstance(value, float) else got == value), translate(text)


@pytest.mark.parametrize(
    "text,dialect,value",
    [
        ("SELECT ifnull(NULL, \"x\")", "mysql", "x"), ("SELECT iif(1 > 2, 'a', 'b')", "sqlserver", "b"), ("SELECT printf('%d-%s', 5, 'x')", "sqlite", "5-x"), ("SELECT 'ABC' ~* 'b'", "postgres", True),
        ("SELECT 'ABC' !~ 'b'", "postgres", True), ("SELECT 'abc' REGEXP 'B'", "sqlite", True), ("SELECT `x` FROM (SELECT 1 AS x) t", "mysql", 1), ("SELECT TOP 1 [x] FROM (VALUES (2), (1)) AS t(x) ORDER BY x", "sqlserver", 1),
        ("SELECT CAST('7' AS UNSIGNED)", "mysql", 7), ("SELECT x FROM (VALUES (2), (1)) AS t(x) ORDER BY x FETCH FIRST 1 ROW ONLY", "postgres", 1),
    ],
)
def test_dialects(spark, text, dialect, value):
    assert one(spark, text, dialect) == value
    if "FETCH" not in text and "~" not in text or dialect == "postgres":
        with pytest.raises(EngineError):
            translate(text, "ansi")


@pytest.mark.parametrize(
    "text,dialect",
    [
        ("SELECT 1 LIMIT 1", "sqlserver"), ("SELECT a FROM t OFFSET 2 ROWS", "sqlserver"), ("SELECT TOP 1 a FROM t ORDER BY a OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", "sqlserver"), ("SELECT a FROM t LIMIT 1 FETCH FIRST 1 ROWS ONLY", "postgres"),
        ("SELECT a FROM t ORDER BY a WHERE a > 1", "ansi"), ("SELECT", "ansi"), ("SELECT a FROM", "ansi"), ("SELECT (1", "ansi"), ("SELECT nofetch FROM t FETCH FIRST ROWS ONLY", "postgres"), ("SELECT 'open", "ansi"), ("SELECT abs()", "ansi"),
        ("SELECT a FROM t GROUP BY", "ansi"), ("SELECT sum(a) OVER (ORDER BY a RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) FROM t", "ansi"),
    ],
)
def test_errors(text, dialect):
    with pytest.raises(EngineError):
        translate(text, dialect)


def test_unknown_functions_are_sparks(spark):
    assert one(spark, "SELECT array_max(array(1, 3, 2))") == 3
    assert is_registered_function("substr") and not is_registered_function("nope")
    assert len(get_registered_functions("scalar")) >= 110
    assert spark.range(1).select(call("LPAD", "'x'", 3, "'-'")).first()[0] == "--x"


def test_types():
    assert str(parse_type("character varying(20)")) == "VARCHAR(20)" and parse_type("NUMERIC(8,2)").spark == "decimal(8,2)"
    assert parse_type("double precision").spark == "double" and parse_type("timestamp with time zone").spark == "timestamp"
    with pytest.raises(EngineError):
        parse_type("PINT")


def test_frames(spark):
    spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, None)], "id int, v int").createOrReplaceTempView("f")
    run = lambda w: [r[0] for r in spark.sql(translate(f"SELECT {w} AS x, id FROM f ORDER BY id")).collect()]
    assert run("sum(v) OVER (ORDER BY v GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)") == [20, 20, 40, 50, 30]
    assert run("sum(v) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)") == [10, 30, 40, 20, 30]
    assert run("min(v) OVER (ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)") == [10, 20, 30, None, None]
    assert run("count(*) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING)") == [1, 2, 3, 4, 5]


# change log


def test_chain_and_replay(spark, tmp_path):
    writer = changelog.LogWriter(clock=iter(range(1, 100)).__next__)
    path = str(tmp_path / "log")
    said = ["INSERT INTO t (id, n) VALUES (1, 'a')", "INSERT INTO t (id, n) VALUES (2, 'it''s')", "INSERT INTO u (id) VALUES (9)", "UPDATE t SET n = NULL WHERE id = 1", "DELETE FROM t WHERE id = 2", "INSERT INTO t (id, n) VALUES (2, 'b')"]
    assert writer.append(spark, path, said[:3]) == 3 and writer.append(spark, path, said[3:]) == 3
    log = changelog.read_log(spark, path, ["t"])
    schema = spark.createDataFrame([], "id long, n string").schema
    good = changelog.verify(log)
    assert good.filter("accepted").count() == 5
    for key in ("id", None):
        assert sorted(map(tuple, changelog.replay(good, schema, key).collect()), key=str) == [(1, None), (2, "b")]
    rows = [r.asDict() for r in log.collect()]
    for r in rows:
        if r["seq"] == 3:
            r["payload_text"] = r["payload_text"].replace("null", '"z"')
    seen = {r["seq"]: r["accepted"] for r in changelog.verify(spark.createDataFrame(rows, log.schema)).collect()}
    assert seen == {1: True, 2: True, 3: False, 4: False, 5: False}
    bare = spark.createDataFrame([r | {"current_commit_hash": None} for r in rows[:1]], log.schema)
    assert [r["accepted"] for r in changelog.verify(bare).collect()] == [True] and [r["accepted"] for r in changelog.verify(bare, strict=True).collect()] == [False]


@pytest.mark.parametrize("text", ["SELECT 1", "INSERT INTO t (a) VALUES (1, 2)", "UPDATE t SET a = 1", "DELETE FROM t WHERE a = 1 AND b = 2", "UPDATE t SET"])
def test_payload_errors(text):
    with pytest.raises(EngineError):
        changelog.payload_of(text)


def test_stream_replay_resumes(spark, tmp_path):
    from quarryline.streaming.replay import LogReplay

    writer, path = changelog.LogWriter(), str(tmp_path / "log")
    schema = spark.createDataFrame([], "id long, n string").schema
    replay = LogReplay(spark, path, "t", schema, "id", str(tmp_path / "out"))
    writer.append(spark, path, ["INSERT INTO t (id, n) VALUES (1, 'a')", "INSERT INTO t (id, n) VALUES (2, 'b')", "INSERT INTO t (id, n) VALUES (3, 'b')"])
    assert replay.run(str(tmp_path / "cp")).count() == 3
    writer.append(spark, path, ["UPDATE t SET n = 'c' WHERE id = 1", "DELETE FROM t WHERE id = 2"])
    assert sorted(map(tuple, replay.run(str(tmp_path / "cp")).collect())) == [(1, "c"), (3, "b")]
    assert sorted(map(tuple, replay.run(str(tmp_path / "cp")).collect())) == [(1, "c"), (3, "b")]
    assert replay.state()["applied"] == 5 and replay.state()["invalid"] == 0


# pages, locks, cost, batches, settings


def test_pages(spark):
    from pyspark.sql import functions as F

    df = spark.range(1250).select("id", (F.col("id") * 2).alias("v"))
    out = pages.page_manifest(df, "t", F.col("id")).orderBy("page_index").collect()
    assert [(r["page_index"], r["row_count"], r["start_row"]) for r in out] == [(0, 500, 0), (1, 500, 500), (2, 250, 1000)]
    assert out[0]["prev_page_hash"] is None and out[1]["prev_page_hash"] == out[0]["object_id"]
    texts = [f'{{"id":{k},"v":{2 * k}}}' for k in range(500)]
    assert out[0]["key_merkle_root"] == pages.merkle_root([pages.sha(t) for t in texts])
    assert out[0]["object_id"] == pages.sha('{"table":"t","pageIndex":0,"rows":[' + ",".join(texts) + "]}")
    again = pages.rechunk(df.filter("id < 700"), df.filter("id >= 700"), F.col("id"), table="t")
    assert pages.manifest_version(again, "t") == pages.manifest_version(pages.page_manifest(df, "t", F.col("id")), "t")
    assert pages.merkle_root([]) is None and pages.merkle_root(["x"]) == "x" and pages.merkle_root(["a", "b", "c"]) == pages.sha(f"L:{pages.sha('L:a|R:b')}|R:{pages.sha('L:c|R:c')}")
    assert [pages.pages_to_read(20, k) for k in ("point", "range", "indexed", "full_scan")] == [1, 6, 2, 20]


def test_locks():
    lock = LockManager()
    lock.record_read("t", "1", "v1")
    lock.record_read("t", "1", "v2")
    assert lock.conflict("t", "1", "v1") is None and lock.conflict("t", "1", "v2").details["expected"] == "v1"
    lock.record_pending("t", "2", "p")
    assert lock.conflict("t", "2", "q") and lock.conflict("t", "3", "q") is None
    lock.confirm("t", "1", "v2", "me")
    assert lock.local("t", "1").row_version == 2 and lock.conflict("t", "1", "v2") is None
    lock.rollback("t")
    assert lock.conflict("t", "2", "q") is None
    for k in range(10):
        lock.confirm("u", str(k), "v", "me")
    lock.prune(3)
    assert sum(t == "u" for t, _ in lock.read) == 3


def test_cost():
    e = cost.estimate_select("SELECT DISTINCT a FROM t ORDER BY a", "range", 1000, 10, False)
    assert (e.objects, e.gas, e.latency_ms) == (3, 152, 193)
    assert cost.estimate_select("SELECT 1", "point", 1, 10, True).gas == 10
    d = cost.estimate_dml("UPDATE t SET a = 1", 10, 5)
    assert (d.gas, d.latency_ms, d.writes) == (350, 500, 10)
    assert cost.check_threshold(cost.estimate_select("SELECT 1", "join", 10, 500, False))[:2] == (True, "warn")


def test_batches():
    done, now = [], [0.0]
    batch = BatchCommitter(done.append, BatchConfig(200, 3, 100), clock=lambda: now[0])
    batch.enqueue("a")
    batch.enqueue("b")
    assert done == []
    batch.enqueue("c")
    assert done == [["a", "b", "c"]]
    batch.enqueue("d")
    now[0] = 0.3
    batch.tick()
    assert done[-1] == ["d"]
    batch.enqueue("big", rows=100)
    assert done[-1] == ["big"]

    def fail(ops):
        batch.enqueue("during")
        raise RuntimeError

    batch.commit = fail
    batch.enqueue("x")
    with pytest.raises(RuntimeError):
        batch.flush()
    assert [op for op, _ in batch.queue] == ["x", "during"] and batch.clear() == 2


def test_settings():
    c = load_config({"QUARRYLINE_DIALECT": "sqlite", "QUARRYLINE_BATCH_MAX_OPS": "7", "QUARRYLINE_STRICT_CHAIN": "true"}, page_size=10)
    assert (c.dialect, c.batch.max_ops, c.strict_chain, c.page_size) == ("sqlite", 7, True, 10)
    for bad in ({"page_size": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            load_config({}, **bad)


def test_merge_conflicts(spark):
    from quarryline.operators.merge import row_version, three_way_merge

    df = lambda *rows: spark.createDataFrame(list(rows), "k int, a string, b int")
    out = {r["k"]: r for r in three_way_merge(df((1, "x", 1), (2, "x", 1), (3, None, 1)), df((1, "y", 1), (2, "y", 1), (3, None, 2)), df((1, "x", 5), (2, "z", 1), (3, "n", 2)), ["k"]).collect()}
    assert (out[1]["a"], out[1]["b"], out[1]["conflict"]) == ("y", 5, False) and out[2]["conflict"] and (out[3]["a"], out[3]["b"]) == ("n", 2)
    assert len(df((1, None, 2)).select(row_version(df((1, None, 2)))).first()[0]) == 64
    assert json.loads('{"a": 1}') == {"a": 1}


@pytest.mark.parametrize("join", ["a JOIN b ON a.x < b.y", "a INNER JOIN b ON a.x < b.y AND a.x > 1", "b JOIN a ON a.x + b.y > 4990", "a CROSS JOIN b"])
def test_joins_of_all_pairs_are_dealt_to_tasks(spark, monkeypatch, join):
    from quarryline.operators import spread

    monkeypatch.setattr(spread, "SIDE_ROWS", 100)
    spark.range(0, 5000, 1, 1).selectExpr("CAST(id AS INT) AS x").createOrReplaceTempView("a")
    spark.sql("SELECT * FROM VALUES (3), (4), (NULL) AS v(y)").createOrReplaceTempView("b")
    text = f"SELECT a.x, b.y FROM {join}"
    got = spark.sql(translate(text, spread=spread.Spread(spark)))
    assert got.rdd.getNumPartitions() == 50
    key = lambda r: (r["x"], r["y"] is None, r["y"])
    assert sorted(got.collect(), key=key) == sorted(spark.sql(translate(text)).collect(), key=key)
    for other in ("SELECT a.x FROM a JOIN b ON a.x = b.y", "SELECT a.x FROM a LEFT JOIN b ON a.x < b.y", "WITH c AS (SELECT 1 AS z) SELECT a.x FROM a JOIN b ON a.x < b.y"):
        assert translate(other, spread=spread.Spread(spark)) == translate(other)


@pytest.mark.parametrize("text", [
    "SELECT k, row_number() OVER (ORDER BY nullif(s, 'b') DESC, k) AS rn FROM t",
    "SELECT u.k + 1 AS k, row_number() OVER (ORDER BY u.k DESC) AS rn, row_number() OVER (ORDER BY u.s NULLS FIRST, u.k) * 2 AS m FROM t AS u WHERE u.k > 100 ORDER BY k LIMIT 500",
])
def test_row_numbers_of_a_table_are_dealt_to_tasks(spark, text):
    from quarryline.operators.spread import Spread

    spark.sql("SELECT CAST(id AS INT) AS k, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS s, id AS other FROM range(3000)").createOrReplaceTempView("t")
    got, plain = spark.sql(translate(text, spread=Spread(spark))), spark.sql(translate(text))
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "__start" not in x]
    assert all("__range" in x for x in windows) and windows
    assert got.dtypes == plain.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("text", [
    "SELECT *, row_number() OVER (ORDER BY k) AS rn FROM t", "SELECT s, row_number() OVER (ORDER BY s) AS rn FROM t GROUP BY s", "SELECT a.k, row_number() OVER (ORDER BY a.k) AS rn FROM t AS a JOIN t AS b ON a.k = b.k",
    "SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM t) AS u WHERE rn < 3", "WITH t AS (SELECT 1 AS k) SELECT row_number() OVER (ORDER BY k) AS rn FROM t", "SELECT row_number() OVER (PARTITION BY s ORDER BY k) AS rn FROM t",
])
def test_other_row_numbers_stay(spark, text):
    from quarryline.operators.spread import Spread

    spark.sql("SELECT CAST(id AS INT) AS k, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS s, id AS other FROM range(3000)").createOrReplaceTempView("t")
    assert translate(text, spread=Spread(spark)) == translate(text)
