"""The engine: SQL text in, DataFrames out.

Queries become Spark SQL and go to Catalyst. Writes are copy-on-write: new Parquet folders are checked
against the table's constraints, then named by the catalog. A folder without affected rows is kept as it
is. The driver holds the catalog only, never rows.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .config import EngineConfig
from .errors import ConstraintError, EngineError, PrivilegeError, SqlError, TransactionError, semantic
from .functions import json as json_functions
from .sources.store import Store
from .sql.lexer import tokenize
from .sql.statements import Statements
from .sql.translate import name as sql_name
from .sql.translate import translate
from .types import SqlType, cast_sql, parse_type

log = logging.getLogger("quarryline")
RIGHTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE", "ALL")


@dataclass
class Result:
    """tag: the statement's kind; df: its rows, if it has any; affected: the rows it wrote."""

    tag: str
    df: DataFrame | None = None
    affected: int = 0


class Engine:
    """A session over a folder of tables. user: whose privileges hold (None: all)."""

    def __init__(self, spark: SparkSession, root: str, dialect: str = "ansi", user: str | None = None, config: EngineConfig | None = None):
        self.config = config or EngineConfig(dialect=dialect)
        self.spark, self.dialect, self.user = spark.newSession(), self.config.dialect, user
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        json_functions.register(self.spark)
        self.store = Store(self.spark, root)
        self.temp: set[str] = set()
        self.known: dict[str, object] = {}
        self.cursors: dict[str, object] = {}
        self.changes = self.total_changes = self.last_rowid = 0
        self.firing = 0
        self.next_modes: dict = {}
        self.defined: dict[str, dict] = {}
        self.define_all()

    # entry points

    def sql(self, text: str) -> Result:
        """Runs one statement. A failed write changes nothing."""
        parsed = Statements(text, self.dialect, self.counters())
        statement = parsed.statement()
        statement["reads"] = parsed.tables
        if statement["kind"] != "rollback":
            self.store.before_statement(self.config.isolation)
        self.define_all()
        self.allow_calls(text)
        if statement["kind"] in WRITES and self.store.saved is not None and self.store.read_only:
            raise TransactionError("the transaction only reads")
        run = getattr(self, f"do_{statement['kind']}")
        if statement["kind"] in WRITES and self.store.saved is None:
            self.store.begin(self.config.isolation)
            try:
                out = run(statement)
                self.check_assertions(deferred=True)
                self.store.commit()
                return out
            except Exception:
                self.store.rollback()
                raise
        if statement["kind"] in WRITES:
            mark = f"\0{len(self.store.savepoints)}"
            self.store.savepoint(mark)
            try:
                return run(statement)
            except Exception:
                self.store.rollback_to(mark)
                raise
            finally:
                self.store.release(mark)
        return run(statement)

    def query(self, text: str) -> DataFrame:
        out = self.sql(text).df
        if out is None:
            raise semantic("the statement gives no rows")
        return out

    def script(self, text: str) -> list[Result]:
        """Runs statements parted by semicolons."""
        tokens, start, out = tokenize(text, self.dialect), 0, []
        for t in tokens:
            if t.up == ";" or t.kind == "end":
                if text[start : t.at].strip():
                    out.append(self.sql(text[start : t.at]))
                start = t.at + 1
        return out

    def counters(self) -> dict[str, str]:
        return {"CHANGES": str(self.changes), "TOTAL_CHANGES": str(self.total_changes), "LAST_INSERT_ROWID": str(self.last_rowid), "TXN_CURRENT": f"'{self.store.txn_id}'" if self.store.saved is not None else "0", "TXN_DIFFERENCE": str(len(self.store.writes)) if self.store.saved is not None else "0"}

    def register(self, name: str, df: DataFrame) -> None:
        """A read-only table from a DataFrame of any session that shares this one's context."""
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan())
        DataFrame(jdf, self.spark).createOrReplaceTempView(name)
        self.temp.add(name.lower())

    def register_function(self, name: str, function, returns: str, aggregate: bool = False) -> None:
        """A scalar function over pandas Series, or an aggregate from one Series to a value, for SQL.

        Both get Arrow batches; an aggregate gets a group at once, so its groups must fit a task.
        """
        from pyspark.sql.pandas.functions import PandasUDFType

        kind = PandasUDFType.GROUPED_AGG if aggregate else PandasUDFType.SCALAR
        self.spark.udf.register(name, F.pandas_udf(function, parse_type(returns).spark, kind))

    # names

    @property
    def state(self) -> dict:
        return self.store.state

    def table(self, name: str) -> dict:
        found = self.find("tables", name)
        if found is None:
            raise semantic(f"no table {name}", token=name)
        return found

    def find(self, what: str, name: str):
        return next((v for k, v in self.state[what].items() if k.lower() == name.lower()), None)

    def key(self, what: str, name: str) -> str:
        return next((k for k in self.state[what] if k.lower() == name.lower()), name)

    def refresh(self) -> None:
        """Temporary views for the tables and views of the state, where they have changed."""
        now = {k: tuple(t["dirs"]) + (str(t["schema"]),) for k, t in self.state["tables"].items()} | {k: v["spark_sql"] for k, v in self.state["views"].items()}
        for k in [k for k in self.known if k not in now]:
            self.spark.catalog.dropTempView(k)
            del self.known[k]
        changed = [k for k in now if self.known.get(k) != now[k]]
        for k in changed:
            if k in self.state["tables"]:
                self.store.read(self.state["tables"][k]).createOrReplaceTempView(k)
                self.known[k] = now[k]
        # a view reads the views and tables before it; all follow a changed table
        if changed:
            for k, v in self.state["views"].items():
                self.run_sql(v["spark_sql"]).createOrReplaceTempView(k)
                self.known[k] = now[k]

    def run_sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for k, df in frames.items():
            df.createOrReplaceTempView(k)
        log.debug("%s", text)
        return self.spark.sql(text)

    def translate(self, text: str) -> str:
        return translate(text, self.dialect, self.counters())

    # privileges

    def allow(self, right: str, table: str) -> None:
        if self.user is None:
            return
        for g in self.state["grants"]:
            if g["to"].lower() in (self.user.lower(), "public") and g["object"].lower() == table.lower() and g["privilege"] in (right, "ALL"):
                return
        raise PrivilegeError(f"{self.user} may not {right} {table}")

    def allow_calls(self, text: str) -> None:
        """EXECUTE on each stored function that a statement calls."""
        if self.user is None or not self.state["functions"]:
            return
        tokens = tokenize(text, self.dialect)
        for t, after in zip(tokens, tokens[1:]):
            if after.text == "(" and t.kind != "string" and self.find("functions", t.text) and tokens[0].up not in ("CREATE", "DROP", "GRANT", "REVOKE"):
                self.allow("EXECUTE", t.text)

    def do_grant(self, s: dict) -> Result:
        for p in s["privileges"]:
            if p not in RIGHTS or (p == "EXECUTE") != (s["what"] == "function") and p != "ALL":
                raise semantic(f"no privilege {p} on a {s['what']}")
        if self.user is not None and not any(g["to"] == self.user and g["object"].lower() == s["object"].lower() and g["option"] for g in self.state["grants"]):
            raise PrivilegeError(f"{self.user} may not grant on {s['object']}")
        for to in s["to"]:
            for p in s["privileges"]:
                old = [g for g in self.state["grants"] if (g["to"], g["object"], g["privilege"]) == (to, s["object"], p)]
                self.state["grants"] = [g for g in self.state["grants"] if g not in old]
                self.state["grants"].append({"to": to, "object": s["object"], "what": s["what"], "privilege": p, "option": s["option"] or any(g["option"] for g in old), "by": self.user})
        return Result("GRANT")

    def do_revoke(self, s: dict) -> Result:
        gone = set(s["from"])
        hit = lambda g: g["to"] in gone and g["object"].lower() == s["object"].lower() and ("ALL" in s["privileges"] or g["privilege"] in s["privileges"])
        dependent = [g for g in self.state["grants"] if g["by"] in gone and g["object"].lower() == s["object"].lower()]
        if dependent and not s["cascade"]:
            raise PrivilegeError("others hold privileges granted by those; use CASCADE")
        if s["option_only"]:
            self.state["grants"] = [g | {"option": False} if hit(g) else g for g in self.state["grants"] if g not in dependent]
        else:
            self.state["grants"] = [g for g in self.state["grants"] if not hit(g) and g not in dependent]
        return Result("REVOKE")

    # queries

    def do_query(self, s: dict) -> Result:
        for t in s["reads"]:
            if self.find("tables", t) or self.find("views", t):
                self.allow("SELECT", t)
        self.refresh()
        return Result("SELECT", self.run_sql(s["sql"]))

    def do_explain(self, s: dict) -> Result:
        self.refresh()
        plan = self.run_sql(s["sql"])._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result("EXPLAIN", self.spark.createDataFrame([(s["sql"], plan)], "query string, plan string"))

    def do_declare(self, s: dict) -> Result:
        self.refresh()
        self.cursors[s["name"].lower()] = (df := self.run_sql(s["sql"])).schema, df.toLocalIterator()
        return Result("CURSOR")

    def do_fetch(self, s: dict) -> Result:
        if s["name"].lower() not in self.cursors:
            raise semantic(f"no cursor {s['name']}")
        schema, rows = self.cursors[s["name"].lower()]
        return Result("CURSOR", self.spark.createDataFrame([r for _, r in zip(range(s["rows"]), rows)], schema))

    def do_close(self, s: dict) -> Result:
        if self.cursors.pop(s["name"].lower(), None) is None:
            raise semantic(f"no cursor {s['name']}")
        return Result("CURSOR")

    # transactions

    def do_begin(self, s: dict) -> Result:
        said, self.next_modes = self.next_modes, {}
        isolation = s["isolation"] or said.get("isolation") or self.config.isolation
        self.store.begin(isolation, s["read_only"] or said.get("read_only", False), self.config.transaction_timeout_ms)
        return Result("BEGIN")

    def do_set_transaction(self, s: dict) -> Result:
        """For the next transaction, or for all of the session."""
        if self.store.saved is not None:
            raise TransactionError("a transaction is open already")
        if s["session"]:
            self.config = replace(self.config, isolation=s["isolation"] or self.config.isolation)
        else:
            self.next_modes = {"isolation": s["isolation"], "read_only": s["read_only"]}
        return Result("SET")

    def do_commit(self, s: dict) -> Result:
        if self.store.saved is None:
            raise TransactionError("no transaction is open")
        try:
            self.check_assertions(deferred=True)
        except EngineError:
            self.store.rollback()
            raise
        self.store.commit()
        return Result("COMMIT")

    def do_rollback(self, s: dict) -> Result:
        self.store.rollback()
        return Result("ROLLBACK")

    def do_savepoint(self, s: dict) -> Result:
        self.store.savepoint(s["name"].lower())
        return Result("SAVEPOINT")

    def do_rollback_to(self, s: dict) -> Result:
        self.store.rollback_to(s["name"].lower())
        return Result("ROLLBACK")

    def do_release(self, s: dict) -> Result:
        self.store.release(s["name"].lower())
        return Result("RELEASE")

    # definitions

    def column(self, c: dict) -> dict:
        """A column with its domain's type and constraints taken over."""
        domain = self.find("domains", c["type"])
        if domain:
            own = domain["column"]
            checks = [(label, check.replace("VALUE", sql_name(c["name"]))) for label, check in own["checks"]]
            return c | {"type": own["type"], "null": c["null"] and own["null"], "default": c["default"] or own["default"], "checks": c["checks"] + checks, "unique": c["unique"] + own["unique"]}
        parse_type(c["type"])
        return c

    def do_create_table(self, s: dict) -> Result:
        if self.find("tables", s["name"]) or self.find("views", s["name"]):
            if s["exists"]:
                return Result("CREATE")
            raise semantic(f"{s['name']} exists", token=s["name"])
        if s["sql"]:
            self.refresh()
            df = self.run_sql(s["sql"])
            columns = [{"name": f.name, "type": None, "spark": f.dataType.simpleString(), "null": True, "default": None, "generated": None} for f in df.schema.fields]
            table = {"schema": df.schema.jsonValue(), "columns": columns, "unique": [], "checks": [], "foreign": [], "dirs": [], "disabled": []}
            self.state["tables"][s["name"]] = table
            table["dirs"] = [self.store.write(s["name"], df)]
            return Result("CREATE")
        table = {"columns": [], "unique": [], "checks": [], "foreign": [], "dirs": [], "disabled": [], "schema": None}
        for c in s["columns"]:
            self.add_column(table, self.column(c))
        for kind, c in s["constraints"]:
            self.add_constraint(table, kind, c)
        self.set_schema(table)
        self.state["tables"][s["name"]] = table
        return Result("CREATE")

    def add_column(self, table: dict, c: dict) -> None:
        if any(o["name"].lower() == c["name"].lower() for o in table["columns"]):
            raise semantic(f"column {c['name']} is there twice")
        table["columns"].append({"name": c["name"], "type": c["type"], "spark": parse_type(c["type"]).spark, "null": c["null"], "default": c["default"]})
        if c["primary"]:
            self.add_constraint(table, "primary", {"name": "primary_key", "columns": [c["name"]]})
        for label in c["unique"]:
            self.add_constraint(table, "unique", {"name": label or f"unique_{c['name']}", "columns": [c["name"]]})
        for label, check in c["checks"]:
            self.add_constraint(table, "checks", {"name": label, "check": check})
        for f in c["foreign"]:
            self.add_constraint(table, "foreign", f)

    def add_constraint(self, table: dict, kind: str, c: dict) -> None:
        if kind == "primary":
            if any(u.get("primary") for u in table["unique"]):
                raise semantic("a table has one primary key")
            table["unique"].append(c | {"primary": True})
            for col in table["columns"]:
                if col["name"].lower() in [x.lower() for x in c["columns"]]:
                    col["null"] = False
        elif kind == "unique":
            table["unique"].append(c | {"primary": False})
        elif kind == "checks":
            table["checks"].append({"name": c["name"] or f"check_{len(table['checks']) + 1}", "check": c["check"]})
        else:
            table["foreign"].append(c | {"name": c["name"] or f"foreign_{len(table['foreign']) + 1}"})

    @staticmethod
    def set_schema(table: dict) -> None:
        out = StructType()
        for c in table["columns"]:
            out.add(c["name"], _spark_type(c["spark"]), True)
        table["schema"] = out.jsonValue()

    def do_create_view(self, s: dict) -> Result:
        if self.find("tables", s["name"]) or self.find("views", s["name"]) and not s["replace"]:
            raise semantic(f"{s['name']} exists", token=s["name"])
        parsed = Statements(s["sql"], self.dialect)
        text = parsed.query()
        if s["columns"]:
            text = f"SELECT * FROM ({text}) AS __v({', '.join(map(sql_name, s['columns']))})"
        self.refresh()
        self.run_sql(text).schema  # fails here if it reads what isn't there
        self.state["views"][s["name"]] = {"sql": s["sql"], "spark_sql": text, "check": s["check"], "reads": parsed.tables, "columns": s["columns"]}
        return Result("CREATE")

    def do_create_schema(self, s: dict) -> Result:
        if s["name"] in self.state["schemas"]:
            if not s["exists"]:
                raise semantic(f"schema {s['name']} exists")
        else:
            self.state["schemas"].append(s["name"])
        return Result("CREATE")

    def do_create_index(self, s: dict) -> Result:
        table = self.table(s["table"])
        if self.find("indexes", s["name"]):
            raise semantic(f"index {s['name']} exists")
        self.state["indexes"][s["name"]] = {"table": s["table"], "columns": s["columns"], "unique": s["unique"], "status": "ACTIVE"}
        if s["unique"]:
            self.add_constraint(table, "unique", {"name": s["name"], "columns": s["columns"]})
            self.check_unique(s["table"], table, self.store.read(table))
        return Result("CREATE")

    def do_create_domain(self, s: dict) -> Result:
        parse_type(s["column"]["type"])
        self.state["domains"][s["name"]] = {"column": s["column"]}
        return Result("CREATE")

    def do_create_assertion(self, s: dict) -> Result:
        self.state["assertions"][s["name"]] = {"check": s["check"], "deferred": s["deferred"]}
        self.check_assertions()
        return Result("CREATE")

    def do_create_trigger(self, s: dict) -> Result:
        if s["time"] not in ("BEFORE", "AFTER") or s["event"] not in ("INSERT", "UPDATE", "DELETE"):
            raise semantic("a trigger is BEFORE or AFTER INSERT, UPDATE or DELETE")
        self.table(s["table"])
        self.state["triggers"][s["name"]] = {k: s[k] for k in ("time", "event", "table", "body")} | {"enabled": True}
        return Result("CREATE")

    def do_create_function(self, s: dict) -> Result:
        f = {k: s[k] for k in ("args", "returns", "body")}
        self.define(s["name"], f)
        self.state["functions"][s["name"]] = self.defined[s["name"]] = f
        if self.user is not None:  # who makes a function may call it and let others
            self.state["grants"].append({"to": self.user, "object": s["name"], "what": "function", "privilege": "EXECUTE", "option": True, "by": None})
        return Result("CREATE")

    def define_all(self) -> None:
        """Makes the session's functions those of the state, after reopening, a rollback or a commit of others."""
        now = self.state["functions"]
        for k in [k for k in self.defined if k not in now]:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {sql_name(k)}")
            del self.defined[k]
        for k, f in now.items():
            if self.defined.get(k) != f:
                self.define(k, f)
                self.defined[k] = f

    def define(self, key: str, f: dict) -> None:
        """Makes a stored function known to the session: an expression's, or a query's with its columns."""
        t = Statements(f["body"], self.dialect)
        rows = not isinstance(f["returns"], str)
        if rows:
            self.refresh()
        body = t.query() if rows else t.expr()
        t.done()
        columns = lambda c: ", ".join(f"{sql_name(n)} {parse_type(k).spark.upper()}" for n, k in c)
        returns = f"TABLE ({columns(f['returns'])})" if rows else parse_type(f["returns"]).spark.upper()
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql_name(key)}({columns(f['args'])}) RETURNS {returns} RETURN {body}")

    def do_drop(self, s: dict) -> Result:
        what = {"index": "indexes"}.get(s["what"], s["what"] + "s")
        if what == "schemas":
            if s["name"] in self.state["schemas"]:
                self.state["schemas"].remove(s["name"])
            return Result("DROP")
        key = self.key(what, s["name"])
        if key not in self.state[what]:
            if s["exists"]:
                return Result("DROP")
            raise semantic(f"no {s['what']} {s['name']}", token=s["name"])
        if what in ("tables", "views"):
            users = [v for v, d in self.state["views"].items() if key.lower() in [r.lower() for r in d["reads"]] and v != key]
            if users and not s["cascade"]:
                raise semantic(f"{', '.join(users)} read {key}; use CASCADE")
            for v in users:
                self.do_drop({"what": "view", "name": v, "exists": True, "cascade": True})
        if what == "tables":
            for child, f in self.referrers(key):
                if child["name"] == key:
                    continue
                if not s["cascade"]:
                    raise semantic(f"{f['name']} of {child['name']} refers to {key}; use CASCADE")
                child["table"]["foreign"].remove(f)
        gone = self.state[what].pop(key)
        if what == "indexes" and gone["unique"]:
            table = self.table(gone["table"])
            table["unique"] = [u for u in table["unique"] if u["name"] != key]
        if what == "tables":
            self.state["triggers"] = {k: v for k, v in self.state["triggers"].items() if v["table"].lower() != key.lower()}
            self.state["indexes"] = {k: v for k, v in self.state["indexes"].items() if v["table"].lower() != key.lower()}
        if what == "functions":
            self.define_all()
        return Result("DROP")

    def referrers(self, key: str) -> list[tuple[dict, dict]]:
        """Foreign keys that refer to a table: the name and table that has one, and it."""
        return [({"name": k, "table": t}, f) for k, t in self.state["tables"].items() for f in t["foreign"] if f["table"].lower() == key.lower()]

    def unread(self, key: str, column: str | None = None) -> None:
        """Raises an error if a view, assertion, trigger or function has the table (and the column, if given) in its
        text, which would no longer hold."""
        texts = [(f"view {k}", v["sql"]) for k, v in self.state["views"].items()] + [(f"assertion {k}", a["check"]) for k, a in self.state["assertions"].items()]
        texts += [(f"trigger {k}", t["body"]) for k, t in self.state["triggers"].items()] + [(f"function {k}", f["body"]) for k, f in self.state["functions"].items()]
        for label, text in texts:
            words = {t.text.lower() for t in tokenize(text, self.dialect) if t.kind != "string"}
            if key.lower() in words and (column is None or column.lower() in words):
                raise semantic(f"{label} reads {key}{f'.{column}' if column else ''}", token=key)

    def do_alter(self, s: dict) -> Result:
        key = self.key("tables", s["table"])
        table, do = self.table(s["table"]), s["do"]
        column = next((c for c in table["columns"] if c["name"].lower() == str(s.get("column", "")).lower()), None) if isinstance(s.get("column"), str) else None
        if isinstance(s.get("column"), str) and column is None:
            raise semantic(f"no column {s['column']} in {key}")
        if do == "add_column":
            c = self.column(s["column"])
            if not c["null"] and c["default"] is None and table["dirs"]:
                raise ConstraintError("NOT NULL", f"{c['name']} needs a default")
            df = self.store.read(table)
            self.add_column(table, c)
            self.set_schema(table)
            if table["dirs"]:
                value = cast_sql(c["default"] or "NULL", parse_type(c["type"]))
                self.rewrite(key, table, df.withColumn(c["name"], F.expr(f"CAST({value} AS {parse_type(c['type']).spark})")))
        elif do in ("drop_column", "rename_column", "set_type"):
            df = self.store.read(table)
            if do == "drop_column":
                self.unread(key, column["name"])
                if any(column["name"].lower() in [x.lower() for x in self.parent(f)[1]] for _, f in self.referrers(key)):
                    raise semantic(f"a foreign key refers to {key}.{column['name']}")
                table["columns"].remove(column)
                df = df.drop(column["name"])
                table["checks"] = [c for c in table["checks"] if renamed(c["check"], column["name"], "x") == c["check"]]
                self.state["indexes"] = {k: i for k, i in self.state["indexes"].items() if i["table"].lower() != key.lower() or column["name"].lower() not in [x.lower() for x in i["columns"]]}
                for part in ("unique", "foreign"):
                    table[part] = [u for u in table[part] if column["name"].lower() not in [x.lower() for x in u["columns"]]]
            elif do == "rename_column":
                if any(c["name"].lower() == s["to"].lower() for c in table["columns"]):
                    raise semantic(f"column {s['to']} is there already")
                self.unread(key, column["name"])
                df = df.withColumnRenamed(column["name"], s["to"])
                for c in table["checks"]:
                    c["check"] = renamed(c["check"], column["name"], s["to"])
                lists = [f["to"] for _, f in self.referrers(key) if f["to"]] + [i["columns"] for i in self.state["indexes"].values() if i["table"].lower() == key.lower()]
                for names in lists:
                    names[:] = [s["to"] if x.lower() == column["name"].lower() else x for x in names]
                for part in ("unique", "foreign"):
                    for u in table[part]:
                        u["columns"] = [s["to"] if x.lower() == column["name"].lower() else x for x in u["columns"]]
                column["name"] = s["to"]
            else:
                kind = parse_type(s["type"])
                df = df.withColumn(column["name"], F.expr(f"CAST({cast_sql(sql_name(column['name']), kind)} AS {kind.spark})"))
                column |= {"type": s["type"], "spark": kind.spark}
            self.set_schema(table)
            self.rewrite(key, table, df)
        elif do == "rename":
            if self.find("tables", s["to"]) or self.find("views", s["to"]):
                raise semantic(f"{s['to']} exists")
            self.unread(key)
            for _, f in self.referrers(key):
                f["table"] = s["to"]
            for part in ("triggers", "indexes"):
                for x in self.state[part].values():
                    x["table"] = s["to"] if x["table"].lower() == key.lower() else x["table"]
            for g in self.state["grants"]:
                g["object"] = s["to"] if g["what"] != "function" and g["object"].lower() == key.lower() else g["object"]
            self.state["tables"][s["to"]] = self.state["tables"].pop(key)
        elif do in ("set_default", "drop_default"):
            column["default"] = s.get("default")
        elif do in ("set_not_null", "drop_not_null"):
            column["null"] = do == "drop_not_null"
            if not column["null"]:
                self.check_rows(key, table, self.store.read(table))
        elif do == "add_constraint":
            self.add_constraint(table, *s["constraint"])
            self.check_table(key, table)
        elif do == "drop_constraint":
            before = sum(len(table[p]) for p in ("unique", "checks", "foreign"))
            for part in ("unique", "checks", "foreign"):
                table[part] = [c for c in table[part] if c["name"] != s["name"]]
            if before == sum(len(table[p]) for p in ("unique", "checks", "foreign")):
                raise semantic(f"no constraint {s['name']}")
        elif do == "disable_constraint":
            table["disabled"].append(s["name"])
        elif do in ("validate_constraint", "enable_constraint"):
            table["disabled"] = [x for x in table["disabled"] if x != s["name"]]
            self.check_table(key, table)
        elif do in ("enable_trigger", "disable_trigger"):
            for k, t in self.state["triggers"].items():
                if t["table"].lower() == key.lower() and s["name"].lower() in (k.lower(), "all"):
                    t["enabled"] = do == "enable_trigger"
        else:
            raise SqlError("SQL_UNSUPPORTED", f"cannot {do.replace('_', ' ')}")
        return Result("ALTER")

    def rewrite(self, key: str, table: dict, df: DataFrame) -> None:
        table["dirs"] = [self.store.write(key, df.select(*(F.col(sql_name(c["name"])) for c in table["columns"])))] if table["dirs"] else []

    # constraints

    def active(self, table: dict, part: str) -> list[dict]:
        return [c for c in table[part] if c["name"] not in table["disabled"]]

    def check_rows(self, key: str, table: dict, rows: DataFrame) -> None:
        """NOT NULL and CHECK on rows, in one pass that stops at the first violation."""
        tests = [(f"NOT NULL {c['name']}", F.col(sql_name(c["name"])).isNull()) for c in table["columns"] if not c["null"]]
        tests += [(f"CHECK {c['name']}", F.expr(f"NOT coalesce({c['check']}, true)")) for c in self.active(table, "checks")]
        if not tests:
            return
        broken = F.coalesce(*(F.when(test, F.lit(label)) for label, test in tests))
        bad = rows.select(broken.alias("broken")).filter("broken is not null").first()
        if bad:
            kind, _, what = bad["broken"].rpartition(" ")
            raise ConstraintError(kind, f"{key}: {bad['broken']} is violated", name=what)

    def check_unique(self, key: str, table: dict, changed: DataFrame, of: set[str] | None = None) -> None:
        """Keys of changed rows occur once in the table; NULL equals nothing outside of primary keys. of: only
        keys with one of these columns are in question."""
        for u in self.active(table, "unique"):
            if of is not None and not of & {c.lower() for c in u["columns"]}:
                continue
            cols = [sql_name(c) for c in u["columns"]]
            whole = self.store.read(table).select(*cols).dropna()
            mine = changed.select(*cols).dropna().distinct()
            twice = whole.join(mine, u["columns"], "left_semi").groupBy(*cols).agg(F.count("*").alias("__n")).filter("__n > 1").first()
            if twice:
                raise ConstraintError("PRIMARY KEY" if u["primary"] else "UNIQUE", f"Duplicate key in {key}: {tuple(twice[:-1])}", name=u["name"])

    def parent(self, f: dict) -> tuple[dict, list[str]]:
        parent = self.table(f["table"])
        to = f["to"] or next((u["columns"] for u in parent["unique"] if u["primary"]), None)
        if not to:
            raise semantic(f"{f['table']} has no primary key to refer to")
        return parent, to

    def check_foreign(self, key: str, table: dict, rows: DataFrame, of: set[str] | None = None) -> None:
        for f in self.active(table, "foreign"):
            if of is not None and not of & {c.lower() for c in f["columns"]}:
                continue
            parent, to = self.parent(f)
            mine = rows.select(*map(sql_name, f["columns"])).distinct()
            nulls = [F.col(sql_name(c)).isNull() for c in f["columns"]]
            any_null = F.lit(False)
            all_null = F.lit(True)
            for n in nulls:
                any_null, all_null = any_null | n, all_null & n
            if f["match"] == "FULL":
                if mine.filter(any_null & ~all_null).first():
                    raise ConstraintError("FOREIGN KEY", f"{key}: {f['name']} is partly NULL", name=f["name"])
            there = self.store.read(parent).select(*(F.col(sql_name(t)).alias(c) for t, c in zip(to, f["columns"])))
            # with MATCH PARTIAL a row that is partly NULL needs a parent that has its other values
            sets = [f["columns"]]
            if f["match"] == "PARTIAL":
                sets += [list(c) for n in range(1, len(f["columns"])) for c in combinations(f["columns"], n)]
            for own in sets:
                these = F.lit(True)
                for c, n in zip(f["columns"], nulls):
                    these = these & (~n if c in own else n)
                lost = mine.filter(these).select(*map(sql_name, own)).join(there, own, "left_anti").first()
                if lost:
                    raise ConstraintError("FOREIGN KEY", f"{key}: {tuple(lost)} is not in {f['table']}", name=f["name"])

    def check_table(self, key: str, table: dict) -> None:
        rows = self.store.read(table)
        self.check_rows(key, table, rows)
        self.check_unique(key, table, rows)
        self.check_foreign(key, table, rows)

    def check_assertions(self, deferred: bool = False) -> None:
        """Those not deferred, or all."""
        due = {k: a for k, a in self.state["assertions"].items() if deferred or not a["deferred"]}
        if due:
            self.refresh()
        for k, a in due.items():
            if self.spark.sql(f"SELECT coalesce({a['check']}, true) AS ok").first()["ok"] is False:
                raise ConstraintError("ASSERTION", f"assertion {k} is violated", name=k)

    def cascade(self, key: str, old: DataFrame | None, event: str = "delete") -> None:
        """What other tables' foreign keys ask for after `old` rows of table key went, or, on event update, changed:
        then old has the new value of a column c as __new_c, where it may differ."""
        if old is None:
            return
        for child_key, child in list(self.state["tables"].items()):
            for f in self.active(child, "foreign"):
                if f["table"].lower() != key.lower():
                    continue
                parent, to = self.parent(f)
                fresh = [f"__new_{t}" if f"__new_{t}" in old.columns else t for t in to]
                if event == "update" and fresh == to or not child["dirs"]:
                    continue
                there = self.store.read(parent).select(*map(sql_name, to))
                gone = old.select(*(F.col(sql_name(t)).alias(c) for t, c in zip(to, f["columns"])), *(F.col(sql_name(n)).alias(f"__to_{c}") for n, c in zip(fresh, f["columns"])))
                gone = gone.dropna(subset=f["columns"]).distinct()
                gone = gone.join(there.select(*(F.col(sql_name(t)).alias(c) for t, c in zip(to, f["columns"]))), f["columns"], "left_anti")
                pairs, gone = gone, gone.select(*map(sql_name, f["columns"])).distinct()
                rows = self.store.read(child)
                if not rows.join(gone, f["columns"], "left_semi").limit(1).count():
                    continue
                action = f[event]
                if action in ("NO ACTION", "RESTRICT"):
                    raise ConstraintError("FOREIGN KEY", f"rows of {child_key} refer to {key}", name=f["name"])
                hit = rows.join(gone, f["columns"], "left_semi")
                if action == "CASCADE" and event == "update":
                    moved = rows.join(pairs.withColumn("__hit", F.lit(True)), f["columns"], "left")
                    mine = {c.lower(): c for c in f["columns"]}
                    now = [F.when(F.col("__hit"), F.col(f"__to_{mine[c['name'].lower()]}")).otherwise(F.col(sql_name(c["name"]))).alias(c["name"]) if c["name"].lower() in mine else F.col(sql_name(c["name"])) for c in child["columns"]]
                    self.rewrite(child_key, child, moved.select(*now))
                    self.check_table(child_key, child)
                    self.cascade(child_key, hit.join(pairs, f["columns"]).withColumnsRenamed({f"__to_{c}": f"__new_{c}" for c in f["columns"]}), "update")
                    continue
                if action == "CASCADE":
                    self.rewrite(child_key, child, rows.join(gone, f["columns"], "left_anti"))
                    self.cascade(child_key, hit)
                    continue
                mark = rows.join(gone.withColumn("__hit", F.lit(True)), f["columns"], "left")
                for c in child["columns"]:
                    if c["name"].lower() in [x.lower() for x in f["columns"]]:
                        value = f"CAST({c['default']} AS {c['spark']})" if action == "SET DEFAULT" and c["default"] else f"CAST(NULL AS {c['spark']})"
                        mark = mark.withColumn(c["name"], F.when(F.col("__hit"), F.expr(value)).otherwise(F.col(sql_name(c["name"]))))
                self.rewrite(child_key, child, mark)
                self.check_table(child_key, child)
                after = {f"__new_{c['name']}": F.expr(f"CAST({c['default']} AS {c['spark']})" if action == "SET DEFAULT" and c["default"] else f"CAST(NULL AS {c['spark']})") for c in child["columns"] if c["name"].lower() in [x.lower() for x in f["columns"]]}
                self.cascade(child_key, hit.withColumns(after), "update")

    def cascade_merge(self, key: str, before: list[str], updated: DataFrame, deleted: DataFrame, target: DataFrame, names: list[str]) -> None:
        """What foreign keys ask for after a MERGE: its deletes, then its updates. before: the table's folders then."""
        old = target.select("__id", *map(sql_name, names))
        if before:
            self.cascade(key, old.join(deleted.select("__id"), "__id", "left_semi").drop("__id"))
            new = updated.select("__id", *(F.col(sql_name(c)).alias(f"__new_{c}") for c in names))
            self.cascade(key, old.join(new, "__id").drop("__id"), "update")

    def fire(self, time: str, event: str, table: str) -> None:
        if self.firing >= 16:
            raise SqlError("SQL_UNSUPPORTED", "triggers call each other too deeply")
        for t in list(self.state["triggers"].values()):
            if t["enabled"] and (t["time"], t["event"]) == (time, event) and t["table"].lower() == table.lower():
                self.firing += 1
                try:
                    self.script(t["body"])
                finally:
                    self.firing -= 1

    # writes

    def through_view(self, s: dict, right: str) -> tuple[str, dict, dict | None]:
        """The table that a write goes to, by its name or through a plain view over it."""
        view = self.find("views", s["table"])
        self.allow(right, s["table"])
        if not view:
            return self.key("tables", s["table"]), self.table(s["table"]), None
        parsed = Statements(view["sql"], self.dialect)
        parsed.need("SELECT")
        parsed.many(parsed.item)
        parsed.need("FROM")
        parsed.joined()
        where = parsed.condition() if parsed.eat("WHERE") else "true"
        if parsed.now.kind != "end" or len(parsed.tables) != 1 or view["columns"]:
            raise semantic(f"cannot write through {s['table']}")
        key, table, inner = self.through_view({"table": parsed.tables[0]}, right) if self.find("views", parsed.tables[0]) else (self.key("tables", parsed.tables[0]), self.table(parsed.tables[0]), None)
        where = f"({where} AND {inner['where']})" if inner else where
        return key, table, {"where": where, "check": view["check"] or bool(inner and inner["check"]), "name": s["table"]}

    def check_view(self, view: dict | None, rows: DataFrame) -> None:
        if view and view["check"] and rows.filter(F.expr(f"NOT coalesce({view['where']}, false)")).first():
            raise ConstraintError("CHECK OPTION", f"rows would leave the view {view['name']}", name=view["name"])

    def typed(self, table: dict, c: dict, x: str) -> str:
        """x as a value of column c; a value that doesn't fit is an error."""
        if c["type"] is None:
            return f"CAST({x} AS {c['spark']})"
        kind: SqlType = parse_type(c["type"])
        return f"CAST(CASE WHEN ({x}) IS NOT NULL AND ({cast_sql(f'({x})', kind)}) IS NULL THEN raise_error('a value does not fit {c['name']} {kind}') ELSE {cast_sql(f'({x})', kind)} END AS {kind.spark})"

    def returned(self, rows: DataFrame, s: dict) -> DataFrame | None:
        return self.run_sql(f"SELECT {', '.join(s['returning'])} FROM __returned", __returned=rows) if s.get("returning") else None

    def counted(self, tag: str, key: str, affected: int, df: DataFrame | None = None) -> Result:
        self.changes = affected
        self.total_changes += affected
        self.store.writes.append({"table": key, "op": tag, "rows": affected})
        return Result(tag, df, affected)

    def do_insert(self, s: dict) -> Result:
        key, table, view = self.through_view(s, "INSERT")
        self.fire("BEFORE", "INSERT", key)
        self.refresh()
        names = [c["name"] for c in table["columns"]]
        given = s["columns"] or names
        for g in given:
            if g.lower() not in [n.lower() for n in names]:
                raise semantic(f"no column {g} in {key}")
        if s["values"] is not None:
            if s["values"] == [[]]:
                given, source = [], "SELECT 1"
            else:
                if any(len(r) != len(given) for r in s["values"]):
                    raise semantic(f"a row needs {len(given)} values")
                defaults = {c["name"].lower(): c["default"] or "NULL" for c in table["columns"]}
                rows = [[defaults[g.lower()] if x == "DEFAULT" else x for g, x in zip(given, r)] for r in s["values"]]
                # each row by itself, as values of a column may have different types
                typed = {c["name"].lower(): c for c in table["columns"]}
                # one projection, whatever the number of rows
                texts = ["struct(" + ", ".join(f"{self.typed(table, typed[g.lower()], x)} AS {sql_name(g)}" for g, x in zip(given, r)) + ")" for r in rows]
                source = f"SELECT inline(array({', '.join(texts)}))"
        else:
            source = s["sql"]
        rows = self.run_sql(source)
        if given and len(rows.columns) != len(given):
            raise semantic(f"the query gives {len(rows.columns)} columns, not {len(given)}")
        rows = rows.toDF(*(f"__i{k}" for k in range(len(rows.columns))))
        place = {g.lower(): f"__i{k}" for k, g in enumerate(given)}
        cast = [f"{self.typed(table, c, place.get(c['name'].lower(), c['default'] or 'NULL'))} AS {sql_name(c['name'])}" for c in table["columns"]]
        path = self.store.write(key, rows.selectExpr(*cast))
        new = self.store.read(table | {"dirs": [path]})
        self.check_view(view, new)
        if s["conflict"]:
            return self.upsert(key, table, new, s)
        self.check_rows(key, table, new)
        old = table["dirs"]
        table["dirs"] = [*old, path]
        self.check_unique(key, table, new)
        self.check_foreign(key, table, new)
        return self.finish("INSERT", key, new, new.count(), s)

    def finish(self, tag: str, key: str, rows: DataFrame, affected: int, s: dict) -> Result:
        self.fire("AFTER", tag, key)
        self.check_assertions()
        if tag == "INSERT":
            self.last_rowid += affected
        return self.counted(tag, key, affected, self.returned(rows, s))

    def upsert(self, key: str, table: dict, new: DataFrame, s: dict) -> Result:
        """INSERT … ON CONFLICT, as a MERGE on the keys."""
        keys = s["conflict"]["keys"] or next((u["columns"] for u in table["unique"] if u["primary"]), None)
        if not keys:
            raise semantic("ON CONFLICT needs keys")
        new.createOrReplaceTempView("excluded")
        clauses = [{"matched": False, "when": None, "do": "insert", "columns": None, "values": [f"excluded.{sql_name(c['name'])}" for c in table["columns"]]}]
        if s["conflict"]["set"]:
            clauses.append({"matched": True, "when": s["conflict"]["where"], "do": "update", "set": s["conflict"]["set"]})
        on = " AND ".join(f"{sql_name(key)}.{sql_name(k)} = excluded.{sql_name(k)}" for k in keys)
        out = self.do_merge({"table": key, "alias": key, "source": "excluded", "on": on, "clauses": clauses, "returning": s["returning"]})
        return Result("INSERT", out.df, out.affected)

    def hits(self, table: dict, alias: str, joins: str, where: str | None, extra: list[str], d: str) -> DataFrame:
        """Rows of folder d of the table that a statement means, each with its place in the files."""
        rows = self.store.read(table | {"dirs": [d]})
        rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        rows.createOrReplaceTempView("__target")
        text = f"SELECT {', '.join([f'{sql_name(alias)}.*', *extra])} FROM __target AS {sql_name(alias)}{joins}{f' WHERE {where}' if where else ''}"
        return self.run_sql(text)

    def do_update(self, s: dict) -> Result:
        key, table, view = self.through_view(s, "UPDATE")
        self.fire("BEFORE", "UPDATE", key)
        self.refresh()
        where = s["where"] if not view else f"({view['where']}{f' AND {s['where']}' if s['where'] else ''})"
        columns = {c["name"].lower(): c for c in table["columns"]}
        for c, _ in s["set"]:
            if c.lower() not in columns:
                raise semantic(f"no column {c} in {key}")
        sets = {c.lower(): self.typed(table, columns[c.lower()], columns[c.lower()]["default"] or "NULL" if x == "DEFAULT" else x) for c, x in s["set"]}
        extra = [f"{x} AS __n_{k}" for k, x in enumerate(sets.values())]
        # columns that foreign keys refer to: their old values are kept for what these ask for
        told = sorted({c.lower() for _, f in self.referrers(key) for c in self.parent(f)[1]} & set(sets))
        alias = s["alias"] if not view else key
        if s["joins"]:
            n, new = self.update_joined(key, table, alias, s["joins"], where, sets, extra, told)
        else:
            n, new = self.update_plain(key, table, alias, where, sets, told)
        self.check_view(view, new)
        self.check_rows(key, table, new)
        if n:
            self.check_unique(key, table, new, set(sets))
            self.check_foreign(key, table, new, set(sets))
            if told:
                self.cascade(key, self.with_rest(new, told), "update")
        return self.finish("UPDATE", key, new.select(*(sql_name(c["name"]) for c in table["columns"])), n, s)

    @staticmethod
    def with_rest(new: DataFrame, told: list[str]) -> DataFrame:
        """Updated rows as they were in the columns told, whose new values are __new_c."""
        names = {c.lower(): c for c in new.columns}
        out = new.withColumns({f"__new_{names[c]}": F.col(sql_name(names[c])) for c in told})
        return out.withColumns({names[c]: F.col(f"__old_{c}") for c in told})

    def update_plain(self, key: str, table: dict, alias: str, where: str | None, sets: dict, told: list[str]) -> tuple[int, DataFrame]:
        """Rewrites the folders that hold rows meant, in one pass without a join. Gives their number and the
        new rows."""
        rows = self.store.read(table)
        if table["dirs"]:
            rows = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("__dir"))
            rows.createOrReplaceTempView("__target")
            text = f"SELECT __dir, count(*) AS n FROM __target AS {sql_name(alias)}{f' WHERE {where}' if where else ''} GROUP BY __dir"
            hits = {r["__dir"]: r["n"] for r in self.run_sql(text).collect()}
            touched = [d for d in table["dirs"] if d.rsplit("/", 1)[1] in hits]
        if not table["dirs"] or not touched:
            return 0, self.store.read(table | {"dirs": []}).withColumns({f"__old_{c}": F.lit(None) for c in told})
        self.store.read(table | {"dirs": touched}).createOrReplaceTempView("__target")
        hit = f"coalesce({where}, false)" if where else "true"
        put = lambda c: f"CASE WHEN __hit THEN {sets[c.lower()]} ELSE {sql_name(alias)}.{sql_name(c)} END AS {sql_name(c)}" if c.lower() in sets else f"{sql_name(alias)}.{sql_name(c)}"
        columns = ", ".join([*(put(c["name"]) for c in table["columns"]), *(f"{sql_name(alias)}.{sql_name(c)} AS __old_{c}" for c in told), "__hit"])
        df = self.run_sql(f"SELECT {columns} FROM (SELECT *, {hit} AS __hit FROM __target AS {sql_name(alias)}) AS {sql_name(alias)}")
        path = self.store.write(key, df)
        table["dirs"] = [*(d for d in table["dirs"] if d not in touched), path]
        return sum(hits.values()), self.spark.read.parquet(f"{self.store.root}/{path}").filter("__hit").drop("__hit")

    def update_joined(self, key: str, table: dict, alias: str, joins: str, where: str | None, sets: dict, extra: list[str], told: list[str]) -> tuple[int, DataFrame]:
        """UPDATE ... JOIN: rows are found by their place in the files. Gives their number and the new rows."""
        n, dirs, changed, order = 0, [], [], list(sets)
        for d in table["dirs"]:
            hit = self.hits(table, alias, joins, where, extra, d)
            # a row that joins several takes the first in the order of the new values
            hit = hit.groupBy("__file", "__row").agg(F.min(F.struct(*(f"__n_{k}" for k in range(len(sets))))).alias("__n")).select("__file", "__row", "__n.*", F.lit(True).alias("__hit"))
            rows = self.store.read(table | {"dirs": [d]})
            rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
            marked = rows.join(hit, ["__file", "__row"], "left")
            new = [F.when(F.col("__hit"), F.col(f"__n_{order.index(c['name'].lower())}")).otherwise(F.col(sql_name(c["name"]))).alias(c["name"]) if c["name"].lower() in sets else F.col(sql_name(c["name"])) for c in table["columns"]]
            path = self.store.write(key, marked.select(*new, *(F.col(sql_name(c)).alias(f"__old_{c}") for c in told), F.coalesce("__hit", F.lit(False)).alias("__hit")))
            part = self.spark.read.parquet(f"{self.store.root}/{path}").filter("__hit").drop("__hit")
            here = part.count()
            if not here:
                self.store.files.remove(path)
                dirs.append(d)
                continue
            n += here
            dirs.append(path)
            changed.append(part)
        table["dirs"] = dirs
        return n, _union(changed) if changed else self.store.read(table | {"dirs": []}).withColumns({f"__old_{c}": F.lit(None) for c in told})

    def do_delete(self, s: dict) -> Result:
        key, table, view = self.through_view(s, "DELETE")
        self.fire("BEFORE", "DELETE", key)
        self.refresh()
        where = s["where"] if not view else f"({view['where']}{f' AND {s['where']}' if s['where'] else ''})"
        n, dirs, lost = 0, [], []
        for d in table["dirs"]:
            hit = self.hits(table, s["alias"] if not view else key, s["joins"], where, [], d).select("__file", "__row").distinct()
            here = hit.count()
            if not here:
                dirs.append(d)
                continue
            rows = self.store.read(table | {"dirs": [d]})
            rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
            lost.append(rows.join(hit, ["__file", "__row"], "left_semi").drop("__file", "__row"))
            kept = rows.join(hit, ["__file", "__row"], "left_anti").drop("__file", "__row")
            dirs.append(self.store.write(key, kept))
            n += here
        gone = _union(lost) if lost else self.store.read(table | {"dirs": []})
        table["dirs"] = dirs
        self.cascade(key, gone if lost else None)
        return self.finish("DELETE", key, gone, n, s)

    def do_truncate(self, s: dict) -> Result:
        key, table, view = self.through_view(s, "DELETE")
        if view:
            raise semantic("a view can't be truncated")
        rows = self.store.read(table)
        n = rows.count()
        table["dirs"] = []
        self.cascade(key, rows if n else None)
        return self.counted("DELETE", key, n)

    def do_merge(self, s: dict) -> Result:
        key, table, view = self.through_view(s, "UPDATE")
        self.allow("INSERT", key)
        self.refresh()
        names = [c["name"] for c in table["columns"]]
        target = self.store.read(table)
        if table["dirs"]:
            # a row's name is short, as it is shuffled: its folder's place, its file's and its own
            parts = [self.store.read(table | {"dirs": [d]}).withColumn("__dir", F.lit(k)).select("*", F.substring_index(F.substring_index("_metadata.file_name", "-", 2), "-", -1).alias("__part"), F.substring_index("_metadata.file_name", "-", -1).alias("__file"), F.col("_metadata.row_index").alias("__row")) for k, d in enumerate(table["dirs"])]
            target = _union(parts).withColumn("__id", F.struct("__dir", "__part", "__file", "__row")).drop("__part", "__file", "__row")
        else:
            target = target.withColumns({"__id": F.lit(None).cast("struct<a:int>"), "__dir": F.lit(None).cast("int")})
        target.createOrReplaceTempView("__target")
        alias, columns = sql_name(s["alias"]), {c["name"].lower(): c for c in table["columns"]}
        matched = [c for c in s["clauses"] if c["matched"]]
        fresh = [c for c in s["clauses"] if not c["matched"]]
        pairs = f"FROM __target AS {alias} JOIN {s['source']} ON {s['on']}"
        which = "CASE " + " ".join(f"WHEN {c['when'] or 'true'} THEN {k}" for k, c in enumerate(matched)) + " END" if matched else "CAST(NULL AS INT)"
        news = []
        for n in names:
            cases = [f"WHEN {k} THEN {self.typed(table, columns[n.lower()], x)}" for k, c in enumerate(matched) if c["do"] == "update" for col, x in c["set"] if col.lower() == n.lower()]
            news.append(f"CASE ({which}) {' '.join(cases)} ELSE {alias}.{sql_name(n)} END AS {sql_name(n)}" if cases else f"{alias}.{sql_name(n)}")
        acts = self.run_sql(f"SELECT {alias}.__id AS __id, {alias}.__dir AS __dir, ({which}) AS __act, {', '.join(news)} {pairs}").filter("__act is not null")
        path = self.store.write(key, acts)
        acts = self.spark.read.parquet(f"{self.store.root}/{path}")
        if acts.groupBy("__id").agg(F.count("*").alias("c")).filter("c > 1").first():
            raise semantic("MERGE changes a row twice")
        deletes = [k for k, c in enumerate(matched) if c["do"] == "delete"]
        updates = [k for k, c in enumerate(matched) if c["do"] == "update"]
        updated, deleted = acts.filter(F.col("__act").isin(updates)) if updates else acts.limit(0), acts.filter(F.col("__act").isin(deletes)) if deletes else acts.limit(0)
        touched = acts.filter(F.col("__act").isin(updates + deletes)) if updates + deletes else acts.limit(0)
        # only folders with rows that change are written again
        hit = {r["__dir"] for r in touched.select("__dir").distinct().collect()}
        stay = [d for k, d in enumerate(table["dirs"]) if k not in hit]
        kept = target.filter(F.col("__dir").isin(list(hit))).join(touched.select("__id"), "__id", "left_anti").select(*map(sql_name, names))
        parts = []
        for c in fresh:
            given = c["columns"] or names
            values = {g.lower(): x for g, x in zip(given, c["values"])}
            row = ", ".join(f"{self.typed(table, columns[n.lower()], values.get(n.lower(), columns[n.lower()]['default'] or 'NULL'))} AS {sql_name(n)}" for n in names)
            parts.append(f"SELECT {row} FROM {s['source']} WHERE NOT EXISTS (SELECT 1 FROM __target AS {alias} WHERE {s['on']}){f' AND {c['when']}' if c['when'] else ''}")
        added = self.store.read(table | {"dirs": [self.store.write(key, self.run_sql(" UNION ALL ".join(parts)))]}) if parts else self.store.read(table | {"dirs": []})
        new = updated.select(*map(sql_name, names)).unionByName(added)
        n_new, n_gone = new.count(), deleted.count()
        path = self.store.write(key, kept.unionByName(new))
        before = table["dirs"]
        table["dirs"] = [*stay, path]
        self.check_view(view, new)
        self.check_rows(key, table, new)
        self.check_unique(key, table, new)
        self.check_foreign(key, table, new)
        if self.referrers(key):
            self.cascade_merge(key, before, updated, deleted, target, names)
        return self.finish("MERGE", key, new, n_new + n_gone, s)


def renamed(text: str, old: str, new: str) -> str:
    """SQL text with a column's name replaced, but in strings and where it names a function."""
    word = rf"'(?:[^']|'')*'|`(?:[^`]|``)*`|(?<![\w.]){re.escape(old)}\b(?!\s*\()"
    put = lambda m: sql_name(new) if m[0].strip("`").lower() == old.lower() and m[0][0] != "'" else m[0]
    return re.sub(word, put, text, flags=re.IGNORECASE)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _spark_type(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


WRITES = {"insert", "update", "delete", "merge", "truncate", "create_table", "create_view", "create_schema", "create_index", "create_domain", "create_assertion", "create_trigger", "create_function", "drop", "alter", "grant", "revoke"}
