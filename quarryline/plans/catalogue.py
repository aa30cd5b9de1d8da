"""The engine's queries over the test tables, with their DuckDB SQL.

Most are SQL of the engine, translated and run by Spark; the others use the operators' DataFrame API, the
store or the change log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as json_functions
from ..operators.spread import Spread
from ..sql import translate

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function as a query."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, dialect: str = "ansi") -> DataFrame:
    """A query of the engine over the tables of a folder."""
    text = translate(sql, dialect)
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    text = translate(sql, dialect, spread=Spread(spark))
    if "ql_json" in text:
        json_functions.register(spark)
    return spark.sql(text)


def sql(name: str, text: str, oracle: str | None = None, dialect: str = "ansi") -> None:
    """Registers SQL of the engine as a query; without an oracle the same text is DuckDB's."""
    query(name, oracle or text)(lambda spark, sf_dir: run_sql(spark, sf_dir, text, dialect))


sql(
    "group_having_topk",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY l_returnflag, l_linestatus""",
)

# projections, filters and predicates

sql("scan_project", "SELECT c_custkey, c_name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'")
sql("constant_scan", "SELECT 1 + 1 AS two, 'it''s' AS said", "SELECT CAST(2 AS INTEGER) AS two, 'it''s' AS said")
sql(
    "filter_3vl",
    "SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'F') = 'O') OR nullif(o_orderpriority, '1-URGENT') IS NULL AND o_totalprice > 1000",
)
sql("between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#11') AND p_size NOT IN (13, 17)")
sql("not_in_null", "SELECT count(*) AS n FROM part WHERE p_size NOT IN (1, 2, NULL)")
sql("like_ci", "SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_name NOT LIKE '_a%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' OR NOT (p_name ILIKE '_a%')")
sql("like_escape", "SELECT p_partkey, p_name || '_%' LIKE '%!_!%' ESCAPE '!' AS a, 'a\\b' LIKE 'A\\B' AS b FROM part", "SELECT p_partkey, true AS a, true AS b FROM part")
sql(
    "case_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders""",
)
sql(
    "is_distinct",
    "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS a, nullif(o_orderstatus, 'F') IS 'O' AS b, nullif(o_orderstatus, 'F') IS NOT 'O' AS c FROM orders",
    "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS a, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS b, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS c FROM orders",
)
sql(
    "arithmetic",
    "SELECT l_orderkey, l_linenumber, l_partkey / nullif(l_linenumber - 1, 0) AS q, l_partkey % (l_linenumber - 1) AS r, -l_linenumber + 2 * l_linenumber - 1 AS s, 7 / 2 AS h FROM lineitem",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) / nullif(l_linenumber - 1, 0) AS q, CASE WHEN l_linenumber <> 1 THEN l_partkey % (l_linenumber - 1) END AS r,
    -l_linenumber + 2 * l_linenumber - 1 AS s, 3.5::DOUBLE AS h FROM lineitem""",
)
sql("overflow_null", "SELECT r_regionkey, 2147483647 + r_regionkey AS a, 2147483647 * (r_regionkey + 1) AS b FROM region", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 2147483647::INTEGER END AS a, CASE WHEN r_regionkey = 0 THEN 2147483647::INTEGER END AS b FROM region")
sql("bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, p_size ^ 5 AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r FROM part", "SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, ~p_size AS n, CAST(p_size * 4 AS INTEGER) AS l, p_size >> 1 AS r FROM part")
sql("concat_op", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, n_name || NULL AS b FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, CAST(NULL AS VARCHAR) AS b FROM nation")
sql("collate_nocase", "SELECT count(*) AS n FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# joins

sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) AS o ON c_custkey = o_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON o_custkey = c_custkey")
sql("join_full", "SELECT s_suppkey, c_custkey FROM supplier s FULL OUTER JOIN (SELECT c_custkey + 20 AS c_custkey FROM customer) c ON s_suppkey = c_custkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
sql("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x LEFT JOIN (SELECT r_regionkey AS k, r_name AS b FROM region WHERE r_regionkey < 3) y USING (k)")
sql("join_multi", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_theta", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey < b.s_suppkey")
sql("lateral_sub", "SELECT r_name, n.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS n")
sql("derived_table", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) AS t WHERE t.n > 2")


@query("join_api", "SELECT o_orderkey, c_name, o_custkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_api(spark, sf_dir):
    from ..operators.relational import join

    return join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "o_custkey", "c_custkey")


# subqueries

sql("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
sql("corr_count", "SELECT n_nationkey, (SELECT count(*) FROM nation AS m WHERE m.n_regionkey = nation.n_regionkey AND m.n_nationkey < nation.n_nationkey) AS before FROM nation")
sql("any_sub", "SELECT p_partkey FROM part WHERE p_size > ANY (SELECT n_nationkey * 2 FROM nation WHERE n_regionkey = 0)")
sql("all_sub", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT n_nationkey * 2 FROM nation WHERE n_regionkey = 0)")
sql("any_in_select", "SELECT n_nationkey, n_nationkey = ANY (SELECT nullif(r_regionkey, 2) FROM region) AS a, n_nationkey <> ALL (SELECT nullif(r_regionkey, 2) FROM region) AS b FROM nation")
sql("exists_in_case", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'big' ELSE 'small' END AS kind FROM customer")

# aggregates

sql("agg_global", "SELECT count(*) AS n, sum(o_custkey) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS first, max(o_orderpriority) AS last FROM orders", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS first, max(o_orderpriority) AS last FROM orders")
sql("agg_empty", "SELECT count(*) AS n, sum(p_size) AS s, total(p_size) AS t FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, 0.0::DOUBLE AS t FROM part WHERE p_size < 0")
sql("group_by", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority, o_orderstatus")
sql("group_expr", "SELECT p_size % 7 AS k, count(*) AS n FROM part GROUP BY p_size % 7")
sql("group_null", "SELECT nullif(o_orderstatus, 'O') AS k, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'O')")
sql("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS s FROM lineitem GROUP BY l_returnflag")
sql("total", "SELECT l_returnflag, total(l_quantity) AS t FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_quantity) AS t FROM lineitem GROUP BY l_returnflag")
sql("group_concat", "SELECT n_regionkey, group_concat(n_name) AS a, group_concat(n_name SEPARATOR '|') AS b, group_concat(n_name ORDER BY n_nationkey DESC SEPARATOR '') AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS a, string_agg(n_name, '|' ORDER BY n_name) AS b, string_agg(n_name, '' ORDER BY n_nationkey DESC) AS c FROM nation GROUP BY n_regionkey")
sql("count_distinct", "SELECT l_shipdate > TIMESTAMP '1998-01-01 00:00:00' AS late, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_shipdate > TIMESTAMP '1998-01-01 00:00:00'", "SELECT l_shipdate > TIMESTAMP '1998-01-01 00:00:00' AS late, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
sql("cond_agg", "SELECT o_custkey % 10 AS k, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY o_custkey % 10", "SELECT o_custkey % 10 AS k, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM orders GROUP BY 1")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# windows

W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, row_number() OVER ({W}) AS rn FROM orders", f"SELECT o_orderkey, CAST(row_number() OVER ({W}) AS INTEGER) AS rn FROM orders")
sql("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r FROM part")
sql("win_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r FROM part")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({W}) AS a, lead(o_totalprice, 2, 0.0) OVER ({W}) AS b FROM orders")
sql("win_first_last", f"SELECT o_orderkey, first_value(o_totalprice) OVER ({W}) AS a, last_value(o_totalprice) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b, last_value(o_orderkey) OVER ({W}) AS c FROM orders")
sql("win_nth", f"SELECT o_orderkey, nth_value(o_orderkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM orders")
sql("win_ntile", f"SELECT o_orderkey, ntile(3) OVER ({W}) AS t FROM orders", f"SELECT o_orderkey, CAST(ntile(3) OVER ({W}) AS INTEGER) AS t FROM orders")
sql("win_pct_cume", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS a, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS b FROM part")
sql("win_running", f"SELECT o_orderkey, count(*) OVER ({W}) AS n, round(sum(o_totalprice) OVER ({W}), 2) AS s, min(o_totalprice) OVER ({W}) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders")
sql("win_rows_frame", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a, count(*) OVER ({W} ROWS 1 PRECEDING) AS n FROM orders")
sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
sql("win_groups_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM part WHERE p_size > 3", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part WHERE p_size > 3")
sql("win_exclude", f"SELECT o_orderkey, count(o_totalprice) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n, round(sum(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s, max(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS m FROM orders")
sql("win_nulls", "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS INTEGER) AS rn FROM orders")


@query("win_groups_api", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part")
def win_groups_api(spark, sf_dir):
    from ..operators.frames import groups_frame

    return groups_frame(table(spark, sf_dir, "part"), "n", lambda: F.count("*"), ["p_brand"], [F.col("p_size")], 2, 0).select("p_partkey", "n")


# sort, limit, set operations, CTEs

sql("sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey LIMIT 40")
sql("sort_nulls_default", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, 1 LIMIT 30", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS LAST, 1 LIMIT 30")
sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("fetch_first", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5", "sqlserver")
sql("top_n", "SELECT TOP 5 [c_custkey] FROM customer ORDER BY c_custkey DESC", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5", "sqlserver")
sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 9")
sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("set_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier")
sql("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1000000) SELECT c_name, round(s, 2) AS s FROM top JOIN customer ON c_custkey = o_custkey")
sql("cte_recursive", "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 25) SELECT k, n_name FROM n JOIN nation ON n_nationkey = k")

# scalar functions

sql(
    "fn_math",
    """SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round(p_retailprice / 7, 2) AS d, trunc(-p_retailprice / 7, 1) AS e, round(sqrt(p_size), 6) AS f,
    power(p_size, 2) AS g, mod(p_size, 7) AS h, sign(p_size - 25) AS i, round(ln(p_size), 6) AS j, round(log(p_size, 2), 6) AS k, sqrt(-1) AS l, ln(0) AS m, square(p_size) AS n, mod(p_size, 0) AS o, round(log10(p_size), 6) AS p FROM part""",
    """SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, round(p_retailprice / 7, 2) AS d, -floor(p_retailprice / 7 * 10) / 10 AS e,
    round(sqrt(p_size), 6) AS f, CAST(p_size * p_size AS DOUBLE) AS g, p_size % 7 AS h, CAST(sign(p_size - 25) AS INTEGER) AS i, round(ln(p_size), 6) AS j, round(log2(p_size), 6) AS k, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS m,
    CAST(p_size * p_size AS DOUBLE) AS n, CAST(NULL AS INTEGER) AS o, round(log10(p_size), 6) AS p FROM part""",
)
sql("fn_trig", "SELECT p_partkey, round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 4) AS c, round(atan2(p_size, 3), 6) AS d, round(degrees(radians(p_size)), 6) AS e, asin(2) AS f, round(pi(), 6) AS g, round(exp(p_size / 10), 4) AS h, round(atan(p_size), 6) AS i, round(acos(1 / p_size), 6) AS j FROM part WHERE p_size > 0", "SELECT p_partkey, round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 4) AS c, round(atan2(p_size, 3), 6) AS d, round(degrees(radians(p_size)), 6) AS e, CAST(NULL AS DOUBLE) AS f, round(pi(), 6) AS g, round(exp(p_size / 10), 4) AS h, round(atan(p_size), 6) AS i, round(acos(1 / p_size), 6) AS j FROM part WHERE p_size > 0")
sql("fn_bit", "SELECT p_partkey, bitand(p_size, 12) AS a, bitor(p_size, 3) AS b, bitxor(p_size, 10) AS c, bitnot(p_size) AS d, lshift(p_size, 3) AS e, rshift(p_size, 2) AS f FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, xor(p_size, 10) AS c, ~p_size AS d, CAST(p_size * 8 AS INTEGER) AS e, p_size >> 2 AS f FROM part")
sql(
    "fn_string",
    """SELECT p_partkey, substr(p_name, 2, 4) AS a, substring(p_name, -3) AS b, length(p_name) AS c, upper(p_name) AS d, lcase(p_type) AS e, trim('  x ') AS f, ltrim('xxy', 'x') AS g, rtrim('yxx', 'x') AS h,
    replace(p_type, 'S', '*') AS i, instr(p_type, 'steel') AS j, reverse(p_brand) AS k, char(65, 66) AS l, concat(p_brand, NULL, 1) AS m, concat_ws('-', p_brand, NULL, 'z') AS n, repeat('ab', 3) AS o,
    left(p_name, 3) AS p, right(p_name, 2) AS q, unicode('A') AS r FROM part""",
    """SELECT p_partkey, substr(p_name, 2, 4) AS a, right(p_name, 3) AS b, CAST(length(p_name) AS INTEGER) AS c, upper(p_name) AS d, lower(p_type) AS e, 'x' AS f, 'y' AS g, 'y' AS h,
    replace(p_type, 'S', '*') AS i, CAST(instr(upper(p_type), 'STEEL') AS INTEGER) AS j, reverse(p_brand) AS k, 'AB' AS l, p_brand || '1' AS m, p_brand || '--z' AS n, 'ababab' AS o,
    left(p_name, 3) AS p, right(p_name, 2) AS q, CAST(65 AS INTEGER) AS r FROM part""",
)
sql("fn_pad", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 4) AS b, quote(p_name) AS c, quote(p_size) AS d, quote(NULL) AS e, repeat('x', -1) AS f FROM part", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 4, ' ') AS b, '''' || replace(p_name, '''', '''''') || '''' AS c, CAST(p_size AS VARCHAR) AS d, 'NULL' AS e, '' AS f FROM part")
sql("fn_regex", "SELECT p_partkey, regexp('^brand#1', p_brand) AS a, regexp_match('[0-9]+', p_brand) AS b, regexp_extract('#([0-9])([0-9])', p_brand, 2) AS c, regexp_replace('[aeiou]', p_name, '*') AS d, regexp_replace('[aeiou]', p_name, '*', 1) AS e, regexp_like(p_type, 'steel', 'c') AS f, regexp_extract('zzz', p_brand) AS g FROM part", "SELECT p_partkey, regexp_matches(p_brand, '(?i)^brand#1') AS a, regexp_extract(p_brand, '[0-9]+') AS b, CASE WHEN regexp_matches(p_brand, '#([0-9])([0-9])') THEN regexp_extract(p_brand, '#([0-9])([0-9])', 2) END AS c, regexp_replace(p_name, '[aeiouAEIOU]', '*', 'g') AS d, regexp_replace(p_name, '[aeiouAEIOU]', '*') AS e, contains(p_type, 'steel') AS f, CAST(NULL AS VARCHAR) AS g FROM part")
sql("fn_glob", "SELECT p_partkey, glob(p_brand, 'Brand#[1-3]?') AS a, p_brand GLOB '*#[!1]*' AS b FROM part", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]?' AS a, p_brand GLOB '*#[!1]*' AS b FROM part")
sql("fn_cond", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, nullif(o_orderstatus, 'O') AS b FROM orders")
sql("fn_ifnull_mysql", "SELECT `o_orderkey`, ifnull(nullif(o_orderstatus, \"F\"), \"none\") AS a FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a FROM orders", "mysql")
sql("fn_iif_sqlserver", "SELECT o_orderkey, iif(o_totalprice > 100000, 'a', 'b') AS a FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'a' ELSE 'b' END AS a FROM orders", "sqlserver")
sql("fn_cast", "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS a, CAST('x' AS INT) AS b, CAST('12.7' AS BIGINT) AS c, CAST(p_size AS VARCHAR(1)) AS d, CAST('true' AS BOOLEAN) AS e, CAST('yes' AS BOOLEAN) AS f, CAST('2024-02-30' AS DATE) AS g, CAST('2024-02-29' AS DATE) AS h, CAST(1.25 AS DECIMAL(4,1)) AS i, CAST(p_size AS TEXT) AS j FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, CAST(12 AS BIGINT) AS c, CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) END AS d, true AS e, CAST(NULL AS BOOLEAN) AS f, CAST(NULL AS DATE) AS g, DATE '2024-02-29' AS h, CAST(NULL AS DECIMAL(4,1)) AS i, CAST(p_size AS VARCHAR) AS j FROM part")
sql("fn_typeof_hex_quote", "SELECT p_partkey, typeof(p_size) AS a, typeof(p_name) AS b, typeof(p_retailprice) AS c, typeof(NULL) AS d, hex(p_brand) AS e, hex(255) AS f FROM part", "SELECT p_partkey, 'integer' AS a, 'text' AS b, 'real' AS c, 'null' AS d, hex(p_brand) AS e, 'FF' AS f FROM part")
sql("fn_printf_sqlite", "SELECT p_partkey, printf('%d/%s %.2f %x%%', p_size, p_brand, p_retailprice, 255) AS a FROM part", "SELECT p_partkey, printf('%d/%s %.2f ff%%', p_size, p_brand, p_retailprice) AS a FROM part", "sqlite")
sql("fn_date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute('2024-03-04 05:06:07') AS i, second('2024-03-04 05:06:07.5') AS s FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(6 AS INTEGER) AS i, CAST(7.5 AS DOUBLE) AS s FROM orders")
sql("fn_date_modifiers", "SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 months', '-1 days') AS a, datetime(o_orderdate, '+3 days') AS b, date(o_orderdate, 'start of week') AS c, date('2024-01-31', '+1 month') AS d, time('2024-01-31 04:05:06') AS e, date('2024/3/5') AS f, date('no date') AS g FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS b, strftime(o_orderdate - CAST(dayofweek(o_orderdate) AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS c, '2024-02-29' AS d, '04:05:06' AS e, '2024-03-05' AS f, CAST(NULL AS VARCHAR) AS g FROM orders")
sql("fn_strftime", "SELECT o_orderkey, strftime('%Y/%m/%d %H:%M:%S %j %w %%', o_orderdate) AS a FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %j %w %%') AS a FROM orders")
sql("fn_julian", "SELECT o_orderkey, round(julianday(o_orderdate), 6) AS a, date(2460310.5) AS b FROM orders", "SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS a, '2024-01-01' AS b FROM orders")
sql("fn_date_trunc_postgres", "SELECT o_orderkey, year(date_trunc('year', o_orderdate)) AS a, o_orderstatus ~ '^[FO]' AS b, o_orderpriority ILIKE '%urgent%' AS c FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, regexp_matches(o_orderstatus, '^[FO]') AS b, o_orderpriority ILIKE '%urgent%' AS c FROM orders", "postgres")

# JSON

sql("json_extract", "SELECT event_id, json_extract(props, '$.k') AS a, json_extract(props, '$.zz') AS b, json_extract('{\"a\":[1,{\"b\":\"x\"}]}', '$.a[1].b') AS c, json_extract('{\"a\":1,\"b\":\"s\"}', '$.a', '$.b') AS d FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, '\"x\"' AS c, '[1,\"s\"]' AS d FROM events")
sql("json_value", "SELECT event_id, json_value(props, '$.k') AS a, json_query(props, '$') AS b, json_value('{\"a\":[1]}', '$.a') AS c, json_query('{\"a\":null}', '$.a') AS d FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, replace(replace(props, ': ', ':'), ', ', ',') AS b, CAST(NULL AS VARCHAR) AS c, 'null' AS d FROM events")
sql("json_type", "SELECT event_id, json_type(props, '$.k') AS a, json_type(props) AS b, json_type('[true,null,\"s\"]', '$[0]') AS c, json_type('[true,null,\"s\"]', '$[1]') AS d, json_type('[true,null,\"s\"]', '$[2]') AS e, json_type('[1]') AS f FROM events", "SELECT event_id, 'integer' AS a, 'object' AS b, 'true' AS c, 'null' AS d, 'text' AS e, 'array' AS f FROM events")
sql("json_valid", "SELECT event_id, json_valid(props) AS a, json_valid('{x') AS b, json_valid(NULL) AS c, json_exists(props, '$.k') AS d, json_exists(props, '$.q') AS e FROM events", "SELECT event_id, 1 AS a, 0 AS b, 0 AS c, 1 AS d, 0 AS e FROM events")
sql("json_keys_length", "SELECT event_id, json_keys(props) AS a, json_length(props) AS b, json_length('[1,2,3]') AS c, json_length('{\"a\":[4]}', '$.a') AS d, json_length('5') AS e FROM events", "SELECT event_id, '[\"k\"]' AS a, 1 AS b, 3 AS c, 1 AS d, 1 AS e FROM events")
sql("json_build", "SELECT event_id, json_object('id', event_id, 'none', NULL) AS a, json_array(event_type, 1, true, NULL) AS b FROM events", "SELECT event_id, '{\"id\":' || event_id || ',\"none\":null}' AS a, '[\"' || event_type || '\",1,true,null]' AS b FROM events")
sql(
    "fn_json_mutate",
    "SELECT event_id, json_set(props, '$.k', 5, '$.a.b', 'x') AS a, json_insert(props, '$.k', 5, '$.n', true) AS b, json_remove(props, '$.k') AS c, json_contains(props, '{}') AS d, json_contains('[1,2]', '2') AS e FROM events",
    "SELECT event_id, '{\"k\":5,\"a\":{\"b\":\"x\"}}' AS a, '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":true}' AS b, '{}' AS c, 1 AS d, 1 AS e FROM events",
)

# writes: a copy of orders in a store of its own; the result is the table after the write


def store(spark: SparkSession, sf_dir: str):
    """An engine with a copy of some orders as table t."""
    from ..engine import Engine

    from ..operators.ranking import shared_folder

    engine = Engine(spark, shared_folder(table(spark, sf_dir, "orders")))
    engine.register("orders", table(spark, sf_dir, "orders"))
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, c BIGINT, s VARCHAR(1) DEFAULT 'N', p DOUBLE CHECK (p >= 0))")
    engine.sql("INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
    return engine


def after(engine, text: str = "SELECT k, c, s, p FROM t") -> DataFrame:
    return engine.query(text)


T = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders"


def write(name: str, statements: str, oracle: str) -> None:
    def run(spark, sf_dir):
        engine = store(spark, sf_dir)
        engine.script(statements)
        return after(engine)

    query(name, oracle)(run)


write("dml_insert_select", "INSERT INTO t (k, c, p) SELECT k + 10000000, c, p FROM t WHERE s = 'F'; INSERT INTO t VALUES (-1, NULL, 'X', 1.5), (-2, 7, DEFAULT, 2)", f"WITH t AS ({T}) SELECT * FROM t UNION ALL SELECT k + 10000000, c, 'N', p FROM t WHERE s = 'F' UNION ALL SELECT -1, NULL, 'X', 1.5 UNION ALL SELECT -2, 7, 'N', 2.0")
write("dml_update", "UPDATE t SET p = p * 2, s = 'U' WHERE c % 3 = 0 AND p < 100000", f"WITH t AS ({T}) SELECT k, c, CASE WHEN c % 3 = 0 AND p < 100000 THEN 'U' ELSE s END AS s, CASE WHEN c % 3 = 0 AND p < 100000 THEN p * 2 ELSE p END AS p FROM t")
write("dml_update_join", "UPDATE t JOIN (SELECT c AS cc, max(k) AS m FROM t GROUP BY c) x ON t.c = x.cc SET p = x.m WHERE t.k < x.m", f"WITH t AS ({T}) SELECT k, c, s, CASE WHEN k < max(k) OVER (PARTITION BY c) THEN CAST(max(k) OVER (PARTITION BY c) AS DOUBLE) ELSE p END AS p FROM t")
write("dml_delete", "DELETE FROM t WHERE s = 'O' OR p > 300000; DELETE FROM t USING (SELECT min(k) AS m FROM t) x WHERE t.k = x.m", f"WITH t AS ({T}), u AS (SELECT * FROM t WHERE NOT (s = 'O' OR p > 300000)) SELECT * FROM u WHERE k <> (SELECT min(k) FROM u)")
write("dml_merge", "MERGE INTO t USING (SELECT k * 2 AS k, c, 'M' AS s, 1.0 AS p FROM t) n ON t.k = n.k WHEN MATCHED AND t.s = 'F' THEN DELETE WHEN MATCHED THEN UPDATE SET s = n.s, p = t.p + n.p WHEN NOT MATCHED THEN INSERT (k, c, s, p) VALUES (n.k, n.c, n.s, n.p)", f"WITH t AS ({T}), n AS (SELECT k * 2 AS k, c, 'M' AS s, 1.0 AS p FROM t) SELECT t.k, t.c, CASE WHEN n.k IS NULL THEN t.s ELSE n.s END AS s, CASE WHEN n.k IS NULL THEN t.p ELSE t.p + n.p END AS p FROM t LEFT JOIN n ON t.k = n.k WHERE n.k IS NULL OR t.s <> 'F' UNION ALL SELECT n.* FROM n WHERE k NOT IN (SELECT k FROM t)")
write("dml_upsert", "INSERT INTO t SELECT k * 2, c, 'M', 1.0 FROM t ON CONFLICT (k) DO UPDATE SET s = excluded.s", f"WITH t AS ({T}), n AS (SELECT k * 2 AS k, c, 'M' AS s, 1.0 AS p FROM t) SELECT t.k, t.c, CASE WHEN n.k IS NULL THEN t.s ELSE n.s END AS s, t.p FROM t LEFT JOIN n ON t.k = n.k UNION ALL SELECT n.* FROM n WHERE k NOT IN (SELECT k FROM t)")
write("view_check", "CREATE VIEW v AS SELECT * FROM t WHERE p > 1000 WITH CHECK OPTION; UPDATE v SET p = p + 1 WHERE s = 'F'; DELETE FROM v WHERE s = 'P'", f"WITH t AS ({T}) SELECT k, c, s, CASE WHEN p > 1000 AND s = 'F' THEN p + 1 ELSE p END AS p FROM t WHERE NOT (p > 1000 AND s = 'P')")
write("txn_savepoint", "BEGIN; DELETE FROM t WHERE s = 'F'; SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; UPDATE t SET s = 'Z' WHERE s = 'P'; COMMIT; BEGIN; DELETE FROM t; ROLLBACK", f"WITH t AS ({T}) SELECT k, c, CASE WHEN s = 'P' THEN 'Z' ELSE s END AS s, p FROM t WHERE s <> 'F'")
write("ddl_alter", "ALTER TABLE t ADD COLUMN q INT DEFAULT 3; ALTER TABLE t RENAME COLUMN s TO z; UPDATE t SET c = q; ALTER TABLE t DROP COLUMN q; ALTER TABLE t RENAME COLUMN z TO s", f"SELECT k, CAST(3 AS BIGINT) AS c, s, p FROM ({T})")


@query("three_way_merge", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'L' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 2 = 0 THEN 2.0 ELSE o_totalprice END AS p, o_orderkey % 6 = 0 AS conflict FROM orders WHERE o_totalprice <> 1.0 AND o_totalprice <> 2.0")
def three_way(spark, sf_dir):
    from ..operators.merge import three_way_merge

    base = table(spark, sf_dir, "orders").filter("o_totalprice <> 1.0 and o_totalprice <> 2.0").selectExpr("o_orderkey as k", "o_orderstatus as s", "o_totalprice as p")
    local = base.selectExpr("k", "case when k % 3 = 0 then 'L' else s end as s", "case when k % 3 = 0 then 1.0D else p end as p")
    remote = base.selectExpr("k", "s", "case when k % 2 = 0 then 2.0D else p end as p")
    return three_way_merge(base, local, remote, ["k"])


# the change log, pages


def orders_log(spark: SparkSession, sf_dir: str, chains: int = 16, changes: bool = True) -> DataFrame:
    """A valid log: an INSERT per order, then an UPDATE or DELETE of some. Orders are dealt to `chains` tables by
    their key; a task chains the records of a table, one after another, as each has the hash of the last. It reads
    them in order and keeps that hash only; what the hashes stand in is put around them by all tasks."""
    import pyarrow as pa

    from ..operators.ranking import shared_folder
    from ..sources import changelog

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    steps = [o.withColumn("step", F.lit(0))]
    if changes:
        steps += [o.filter("o_orderkey % 3 = 0").withColumn("step", F.lit(1)), o.filter("o_orderkey % 5 = 0").withColumn("step", F.lit(2))]
    rows = reduce(DataFrame.union, steps).withColumn("table_id", F.concat(F.lit("o"), F.col("o_orderkey") % chains))
    step = F.col("step")
    row = F.concat(F.lit('{"k":'), F.col("o_orderkey"), F.lit(',"s":"'), F.col("o_orderstatus"), F.lit('"}'))
    parts = [F.element_at(F.array(*map(F.lit, changelog.OPS)), step + 1).alias("op"), F.when(step == 0, row).alias("row"), F.when(step == 1, F.lit('{"s":null}')).alias("set"), F.when(step > 0, F.col("o_orderkey").cast("string")).alias("where")]
    payload = F.to_json(F.struct(F.lit(1).alias("v"), F.col("table_id").alias("table"), *parts, F.lit("").alias("previousCommitHash")), {"ignoreNullFields": "false"})
    said = F.substr(payload, F.lit(1), F.length(payload) - 2)  # up to the hash of the record before

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, seq = object(), changelog.GENESIS, 0
        for batch in batches:
            seqs, before, digests = [], [], []
            for t, text in zip(batch["table_id"].to_pylist(), batch["said"].to_pylist()):
                if t != chain:
                    chain, last, seq = t, changelog.GENESIS, 0
                seq += 1
                seqs.append(seq)
                before.append(last)
                last = changelog.sha(f'{text}{last}"}}')
                digests.append(last)
            kept = batch.drop_columns(["said"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seqs, pa.int64()), pa.array(before, pa.string()), pa.array(digests, pa.string())], [*kept.schema.names, "seq", "before", "digest"])

    # a log is a table: its chains are made once, not by each of its readers
    path = f"{shared_folder(rows)}/log"
    ordered = rows.repartition("table_id").sortWithinPartitions("table_id", "step", F.asc_nulls_last("o_orderkey"))
    kept = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    schema = f"{kept},seq:bigint,before:string,digest:string".replace(":", " ")
    ordered.withColumn("said", said).mapInArrow(chained, schema).write.parquet(path)
    text = F.concat(said, "before", F.lit('","currentCommitHash":"'), "digest", F.lit('"}'))
    return spark.read.schema(schema).parquet(path).select(
        "table_id", "seq", F.concat("table_id", F.lit(":"), "seq").alias("tx_digest"), F.lit(1).alias("v"), parts[0], parts[1].alias("row_json"), parts[2].alias("set_json"), F.when(step > 0, F.lit("k")).alias("where_field"),
        parts[3].alias("where_value"), F.col("before").alias("previous_commit_hash"), F.col("digest").alias("current_commit_hash"), F.col("seq").alias("ts"), text.alias("payload_text"),
    )


LOG_ORACLE = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0"


def log_schema():
    from pyspark.sql.types import StructType

    return StructType().add("k", "long").add("s", "string")


@query("log_replay_batch", LOG_ORACLE)
def log_replay_batch(spark, sf_dir):
    from ..sources import changelog

    return changelog.replay(changelog.verify(orders_log(spark, sf_dir)).filter("accepted"), log_schema(), "k")


@query("log_replay_ordered", LOG_ORACLE)
def log_replay_ordered(spark, sf_dir):
    from ..sources import changelog

    return changelog.replay(changelog.verify(orders_log(spark, sf_dir)).filter("accepted"), log_schema())


@query("log_replay_stream", LOG_ORACLE)
def log_replay_stream(spark, sf_dir):
    from ..operators.ranking import shared_folder
    from ..streaming.replay import LogReplay

    log = orders_log(spark, sf_dir, chains=1)
    root = shared_folder(log)
    log.write.parquet(f"{root}/log")
    return LogReplay(spark, f"{root}/log", "o0", log_schema(), "k", f"{root}/out").run(f"{root}/checkpoint")


@query("chain_verify", "SELECT 'o' || chain AS table_id, CASE WHEN chain % 2 = 1 THEN n - 6 ELSE 0 END AS bad FROM (SELECT o_orderkey % 16 AS chain, count(*) + count(*) FILTER (o_orderkey % 3 = 0) + count(*) FILTER (o_orderkey % 5 = 0) AS n FROM orders GROUP BY 1)")
def chain_verify(spark, sf_dir):
    """In every second chain the seventh record is changed: it and all that follow it are rejected."""
    from ..sources import changelog

    changed = (F.col("seq") == 7) & (F.substr("table_id", F.lit(2)).cast("int") % 2 == 1)
    broken = orders_log(spark, sf_dir).withColumn("payload_text", F.when(changed, F.replace("payload_text", F.lit('"v":1'), F.lit('"v":2'))).otherwise(F.col("payload_text")))
    return changelog.verify(broken).groupBy("table_id").agg(F.count(F.when(~F.col("accepted"), 1)).alias("bad"))


def pages_oracle() -> str:
    """DuckDB SQL of merkle_pages: a page of 500 rows has nine levels above its rows."""
    row = "'{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_totalprice\":' || o_totalprice || ',\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}'"
    out = f"WITH r AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page_index, (row_number() OVER (ORDER BY o_orderkey) - 1) % 500 AS i, {row} AS j FROM orders), l0 AS (SELECT page_index, i, sha256(j) AS h FROM r)"
    for k in range(9):
        left, right = "max(h) FILTER (i % 2 = 0)", "max(h) FILTER (i % 2 = 1)"
        out += f", l{k + 1} AS (SELECT page_index, i // 2 AS i, CASE WHEN any_value(n) = 1 THEN max(h) ELSE sha256('L:' || {left} || '|R:' || coalesce({right}, {left})) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY page_index) AS n FROM l{k}) GROUP BY page_index, i // 2)"
    out += ", p AS (SELECT page_index, count(*) AS row_count, sha256('{\"table\":\"orders\",\"pageIndex\":' || page_index || ',\"rows\":[' || string_agg(j, ',' ORDER BY i) || ']}') AS object_id FROM r GROUP BY page_index)"
    return out + " SELECT p.page_index, row_count, p.page_index * 500 AS start_row, object_id, lag(object_id) OVER (ORDER BY p.page_index) AS prev_page_hash, h AS key_merkle_root FROM p JOIN l9 ON l9.page_index = p.page_index"


@query("merkle_pages", pages_oracle())
def merkle_pages(spark, sf_dir):
    from ..sources.pages import page_manifest

    return page_manifest(table(spark, sf_dir, "orders"), "orders", F.col("o_orderkey"))


@query("page_ranges", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page_index, count(*) OVER () AS n, o_orderkey FROM orders")
def page_ranges(spark, sf_dir):
    from ..operators.ranking import global_row_number

    rows = table(spark, sf_dir, "orders")
    ranked = global_row_number(rows.select("o_orderkey"), F.col("o_orderkey"))
    return ranked.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select(F.floor((F.col("rn") - 1) / 500).cast("long").alias("page_index"), "n", "o_orderkey")


@query("cost_estimate", "SELECT 1300 AS gas, 536 AS latency_ms, 10 AS objects, 46 AS score")
def cost_estimate(spark, sf_dir):
    from ..sources.cost import estimate_select

    e = estimate_select("SELECT a, count(*) FROM t GROUP BY a", "full_scan", 5000, 10, False)
    return spark.createDataFrame([(e.gas, e.latency_ms, e.objects, e.score)], "gas int, latency_ms int, objects int, score int")


from . import behaviours  # noqa: E402, F401  (registers its queries)
