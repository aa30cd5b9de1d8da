"""Paged snapshots: rows in pages of a fixed size, each with a hash and a Merkle root of its rows."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number

PAGE_SIZE = 500


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_root(hashes: list[str]) -> str | None:
    """Pairs are hashed level by level as `L:left|R:right`; a hash without a partner is its own. None for none."""
    level = list(hashes)
    while len(level) > 1:
        level = [sha(f"L:{level[k]}|R:{level[k + 1] if k + 1 < len(level) else level[k]}") for k in range(0, len(level), 2)]
    return level[0] if level else None


def page_manifest(df: DataFrame, table: str, *order: Column, page_size: int = PAGE_SIZE) -> DataFrame:
    """page_index, row_count, start_row, object_id, prev_page_hash, key_merkle_root for the pages of df in
    an order. object_id is the sha256 of the page's rows as JSON with table and index. A task holds
    single pages only; a page finds the one before it by a join on the index."""
    roots = F.pandas_udf(lambda lists: pd.Series([merkle_root(list(h)) for h in lists]), "string", F.PandasUDFType.SCALAR)
    ranked = global_row_number(df.select("*", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("__json")), *order, name="__rn")
    paged = ranked.select(F.floor((F.col("__rn") - 1) / page_size).cast("long").alias("page_index"), "__rn", "__json")
    pages = paged.groupBy("page_index").agg(F.count("*").alias("row_count"), F.sort_array(F.collect_list(F.struct("__rn", "__json"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["__json"]), ",")
    head = F.concat(F.lit(f'{{"table":"{table}","pageIndex":'), F.col("page_index").cast("string"), F.lit(',"rows":['))
    pages = pages.select(
        "page_index", "row_count", (F.col("page_index") * page_size).alias("start_row"), F.sha2(F.concat(head, body, F.lit("]}")), 256).alias("object_id"),
        roots(F.transform("rows", lambda r: F.sha2(r["__json"], 256))).alias("key_merkle_root"),
    )
    before = pages.select((F.col("page_index") + 1).alias("page_index"), F.col("object_id").alias("prev_page_hash"))
    return pages.join(before, "page_index", "left").select("page_index", "row_count", "start_row", "object_id", "prev_page_hash", "key_merkle_root")


def manifest_version(manifest: DataFrame, table: str) -> str:
    """The snapshot's version: sha256 over the table's name, counts and last page."""
    s = manifest.agg(F.count("*").alias("pages"), F.sum("row_count").alias("rows"), F.max(F.struct("page_index", "object_id")).alias("last")).first()
    last = s["last"]["object_id"] if s["last"] else "GENESIS"
    return sha(f'{{"table":"{table}","pageCount":{s["pages"]},"rowCount":{s["rows"] or 0},"lastPageHash":"{last}"}}')


def rechunk(pages: DataFrame, new_rows: DataFrame, *order: Column, table: str = "", page_size: int = PAGE_SIZE) -> DataFrame:
    """The manifest after new rows came; pages and new_rows have the same columns."""
    return page_manifest(pages.unionByName(new_rows), table, *order, page_size=page_size)


def pages_to_read(page_count: int, query: str) -> int:
    """Pages that a point, range (30 %), indexed (10 %) or full query reads."""
    share = {"point": None, "range": 0.3, "indexed": 0.1}.get(query, 1.0)
    return 1 if share is None else math.ceil(page_count * share)
