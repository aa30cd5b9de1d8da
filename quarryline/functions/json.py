"""JSON functions: JSON text in, JSON text out. Reading goes through VARIANT; JSON_SET, JSON_INSERT,
JSON_REMOVE and JSON_CONTAINS, which rewrite or compare trees, are Arrow UDFs that `register` adds to a
session."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .registry import alias, function

NONE = "map('ignoreNullFields', 'false')"


def at(doc: str, path: str) -> str:
    return f"to_json(try_variant_get(try_parse_json({doc}), {path}, 'variant'))"


alias("JSON", "if(try_parse_json({0}) IS NOT NULL, {0}, NULL)", 1)
alias("JSON_VALID", "CAST(try_parse_json({0}) IS NOT NULL AS INT)", 1)
alias("JSON_EXISTS", "CAST(try_variant_get(try_parse_json({0}), {1}, 'variant') IS NOT NULL AS INT)", 2)


@function("JSON_EXTRACT", 2, None)
def json_extract(doc: str, *paths: str) -> str:
    found = [at(doc, p) for p in paths]
    if len(found) == 1:
        return found[0]
    return f"if(try_parse_json({doc}) IS NULL, NULL, concat('[', array_join(array({', '.join(f'coalesce({x}, {chr(39)}null{chr(39)})' for x in found)}), ','), ']'))"


@function("JSON_OBJECT", 0, None)
def json_object(*pairs: str) -> str:
    if len(pairs) % 2:
        return "CAST(NULL AS STRING)"
    return f"to_json(named_struct({', '.join(pairs)}), {NONE})" if pairs else "'{}'"


@function("JSON_ARRAY", 0, None)
def json_array(*items: str) -> str:
    return f"to_json(array({', '.join(f'CAST({x} AS VARIANT)' for x in items)}))" if items else "'[]'"


@function("JSON_TYPE", 1, 2)
def json_type(doc: str, path: str = "'$'") -> str:
    kind = f"schema_of_variant(try_variant_get(try_parse_json({doc}), {path}, 'variant'))"
    return f"CASE WHEN {kind} IS NULL THEN NULL WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} = 'BOOLEAN' THEN 'true' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} LIKE 'OBJECT%' THEN 'object' ELSE 'integer' END"


@function("JSON_LENGTH", 1, 2)
def json_length(doc: str, path: str = "'$'") -> str:
    x = at(doc, path)
    return f"CASE WHEN {x} LIKE '[%' THEN json_array_length({x}) WHEN {x} LIKE '{{%' THEN size(json_object_keys({x})) WHEN {x} IS NOT NULL THEN 1 END"


@function("JSON_KEYS", 1, 2)
def json_keys(doc: str, path: str = "'$'") -> str:
    return f"to_json(json_object_keys({at(doc, path)}))"


@function("JSON_VALUE", 2)
def json_value(doc: str, path: str) -> str:
    return f"CASE WHEN left({at(doc, path)}, 1) NOT IN ('{{', '[') THEN try_variant_get(try_parse_json({doc}), {path}, 'string') END"


@function("JSON_QUERY", 2)
def json_query(doc: str, path: str) -> str:
    x = at(doc, path)
    return f"CASE WHEN left({x}, 1) IN ('{{', '[') OR {x} = 'null' THEN {x} END"


def boxed(x: str) -> str:
    """A value as JSON text that keeps its type."""
    return f"to_json(named_struct('v', {x}), {NONE})"


def changer(name: str):
    def render(doc: str, *pairs: str) -> str:
        if not pairs or len(pairs) % 2:
            return "CAST(NULL AS STRING)"
        return f"{name}({doc}, array({', '.join(pairs[::2])}), array({', '.join(map(boxed, pairs[1::2]))}))"

    return render


function("JSON_SET", 3, None)(changer("ql_json_set"))
function("JSON_INSERT", 3, None)(changer("ql_json_insert"))


@function("JSON_REMOVE", 2, None)
def json_remove(doc: str, *paths: str) -> str:
    return f"ql_json_remove({doc}, array({', '.join(paths)}))"


alias("JSON_CONTAINS", "ql_json_contains({0}, {1})", 2)


def steps(path: str) -> list[str | int] | None:
    """The keys and indexes of a path such as $.a[0]."b c", or None if it is none."""
    if not re.fullmatch(r"""\$(\.[^.\[\]"]+|\."[^"]*"|\[\d+\])*""", path or ""):
        return None
    return [int(i) if i else k or q for k, q, i in re.findall(r"""\.([^.\[\]"]+)|\."([^"]*)"|\[(\d+)\]""", path)]


def put(node, way: list, value, replace: bool):
    """node with value at the end of way; missing parents are made."""
    if not way:
        return value if replace else node
    key, rest = way[0], way[1:]
    if isinstance(key, int):
        node = list(node) if isinstance(node, list) else []
        if key > len(node):
            return node
        old = [node[key]] if key < len(node) else []
        if old and not rest and not replace:
            return node
        node[key : key + 1] = [put(old[0] if old else None, rest, value, replace) if rest else value]
        return node
    node = dict(node) if isinstance(node, dict) else {}
    if rest:
        node[key] = put(node.get(key), rest, value, replace)
    elif replace or key not in node:
        node[key] = value
    return node


def drop(node, way: list):
    if not way:
        return node
    key, rest = way[0], way[1:]
    if isinstance(node, list) and isinstance(key, int) and key < len(node):
        node = node[:key] + ([drop(node[key], rest)] if rest else []) + node[key + 1 :]
    elif isinstance(node, dict) and key in node:
        node = {k: drop(v, rest) if k == key else v for k, v in node.items() if rest or k != key}
    return node


def contains(whole, part) -> bool:
    if part is None:
        return True
    if isinstance(whole, list):
        return all(any(contains(w, p) for w in whole) for p in part) if isinstance(part, list) else any(contains(w, part) for w in whole)
    if isinstance(whole, dict) and isinstance(part, dict):
        return all(k in whole and contains(whole[k], v) for k, v in part.items())
    return type(whole) is type(part) and whole == part


def parsed(text):
    try:
        return json.loads(text) if text is not None else ...
    except ValueError:
        return ...


def dumped(node) -> str:
    return json.dumps(node, separators=(",", ":"), ensure_ascii=False)


def register(spark: SparkSession) -> None:
    """Adds the UDFs behind the rewriting functions to the session."""

    def change(replace: bool):
        def run(docs: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
            out = []
            for doc, ways, boxes in zip(docs, paths, values):
                node, ways = parsed(doc), [steps(p) for p in ways]
                if node is ... or None in ways:
                    out.append(None)
                    continue
                for way, box in zip(ways, boxes):
                    node = put(node, way, json.loads(box).get("v"), replace)
                out.append(dumped(node))
            return pd.Series(out, dtype=object)

        return run

    def remove(docs: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for doc, ways in zip(docs, paths):
            node, ways = parsed(doc), [steps(p) for p in ways]
            if node is ... or None in ways:
                out.append(None)
                continue
            for way in ways:
                node = drop(node, way)
            out.append(dumped(node))
        return pd.Series(out, dtype=object)

    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [(parsed(x), parsed(y)) for x, y in zip(a, b)]
        return pd.Series([None if ... in (x, y) else int(contains(x, y)) for x, y in pairs], dtype="Int32")

    spark.udf.register("ql_json_set", F.pandas_udf(change(True), "string"))
    spark.udf.register("ql_json_insert", F.pandas_udf(change(False), "string"))
    spark.udf.register("ql_json_remove", F.pandas_udf(remove, "string"))
    spark.udf.register("ql_json_contains", F.pandas_udf(within, "int"))
