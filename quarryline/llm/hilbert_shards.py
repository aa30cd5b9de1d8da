"""Sharding by Hilbert order: rows are sorted along a Hilbert curve through quantised metadata and the
order is cut into shards of equal row counts and these into runs, so a run covers a small box of every
dimension and files can be pruned by any of them.

The global rank needs no global sort: the curve's cells are bounded (2**(dims * bits)), cells are
parted into buckets by ranges of hashes, and a row's rank is the count of rows in earlier cells, plus
earlier buckets of its cell, plus its place in its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ._common import scratched, stage, table


def hilbert_index(point: list[int], bits: int) -> int:
    """Place of a grid point along the Hilbert curve (Skilling's transpose form, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def curve(spark, dims: int, bits: int) -> DataFrame:
    """code (the dims' grid numbers, `bits` bits each), cell (its place on the curve): 2**(dims * bits) rows."""
    mask = (1 << bits) - 1
    rows = [(code, hilbert_index([code >> bits * (dims - 1 - d) & mask for d in range(dims)], bits)) for code in range(1 << dims * bits)]
    return spark.createDataFrame(rows, "code int, cell int")


def log_bin(x: Column, bits: int) -> Column:
    """Grid number of a size: its binary logarithm."""
    return F.least(F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def name_bin(docs: DataFrame, name: str, bits: int) -> Column:
    """Grid number of a name, in code point order, so that near cells hold near names: the distinct names are cut
    into 2**bits - 1 equal ranges, from 1 on; null is 0. The driver gets the first name of each range."""
    names = docs.select(F.col(name).alias("name")).filter("name is not null").distinct()
    ranks = global_row_number(names, F.col("name"), name="rank")
    total = ranks.agg(F.max("rank")).first()[0] or 0
    ranges = (1 << bits) - 1
    each = F.floor((F.col("rank") - 1) * ranges / F.lit(max(total, ranges)))
    firsts = sorted(r["name"] for r in ranks.groupBy(each.alias("range")).agg(F.min("name").alias("name")).collect())
    return F.when(F.col(name).isNull(), 0).otherwise(sum((F.when(F.col(name) >= x, 1).otherwise(0) for x in firsts), F.lit(0))).cast("int")


#: Rows that a task ranks at a time, about.
BUCKET_ROWS = 4096


@scratched
def shard_by_curve(docs: DataFrame, dims: list[Column], shards: int, bits: int = 4, run_rows: int = 1 << 16, bucket_rows: int = BUCKET_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard, slot, run and the columns of keep for every row of docs.

    dims: grid numbers of 0 to 2**bits - 1 each. Rows are ranked by their cell on the curve, the md5 of their
    text, the md5 of their id (as text, a null one empty), the id and the size; so equal texts with equal
    grid numbers stand together. The rank is cut into shards whose sizes differ by one row at most; slots
    count from 0 in each, and every run_rows slots are a run, to be written as a file (run_bounds has what
    each holds). A null text is empty, a null id sorts last; repeated rows each get a slot; very long texts
    are only hashed; an empty table gives no rows. Columns other than those used are ignored.

    A cell is parted by ranges of the text's md5 into as many buckets as its rows ask for, a text that has
    more rows than a bucket by ranges of the id's; so a cell with a third of all rows, even of one text,
    spreads over many tasks.
    """
    if len(dims) * bits > 12:
        raise ValueError("the curve has more than 4096 cells")
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    code = sum((d * (1 << bits * (len(dims) - 1 - k)) for k, d in enumerate(dims)), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), code.cast("int").alias("code"),
        F.md5(raw).alias("_th"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_dh"), *keep,
    )
    # the curve's table has 4096 rows at most
    rows = stage(rows.join(F.broadcast(curve(spark, len(dims), bits)), "code").drop("code"), "curve-rows")
    part = lambda h, n: F.floor(F.conv(F.substr(h, F.lit(1), F.lit(7)), 16, 10).cast("long") * n / (1 << 28)).cast("int")
    # 4096 rows at most, so one task may order them
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.ceil(F.col("n") / bucket_rows).alias("parts"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_at"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    cells = stage(cells, "curve-cells")
    total = (cells.select("total").first() or [0])[0]
    rows = rows.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("_a", part(F.col("_th"), F.col("parts"))).drop("parts")
    # texts with very many rows, fewer than 1000 of them by their counts; rows before, of and after one differ in _b
    most = max(bucket_rows, total // 1000)
    hot = rows.groupBy("cell", "_a", "_th").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = hot.groupBy("cell", "_a").agg(F.sort_array(F.collect_list("_th")).alias("_hot"), F.max(F.ceil(F.col("n") / bucket_rows)).alias("_wide"))
    rows = rows.join(F.broadcast(hot), ["cell", "_a"], "left")
    is_hot = F.coalesce(F.array_contains("_hot", F.col("_th")), F.lit(False))
    rows = rows.withColumn("_b", F.coalesce(2 * F.size(F.filter("_hot", lambda h: h < F.col("_th"))) + is_hot.cast("int"), F.lit(0)))
    rows = rows.withColumn("_c", F.when(is_hot, part(F.col("_dh"), F.col("_wide"))).otherwise(0)).drop("_hot", "_wide")
    bucket = ["_a", "_b", "_c"]
    counts = rows.groupBy("cell", *bucket).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell").orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("cell", *bucket, F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("bucket_at"))
    at = Window.partitionBy("cell", *bucket).orderBy("_th", "_dh", F.col("doc_id").asc_nulls_last(), "size")
    ranked = rows.withColumn("k", F.row_number().over(at) - 1).join(counts, ["cell", *bucket]).join(F.broadcast(cells.drop("parts")), "cell")
    rank = F.col("cell_at") + F.col("bucket_at") + F.col("k")
    ranked = ranked.withColumn("rank", rank).withColumn("shard", F.floor(((F.col("rank") + 1) * shards - 1) / F.col("total")).cast("int"))
    first = F.expr(f"(shard * total) div {shards}")
    ranked = ranked.withColumn("slot", (F.col("rank") - first).cast("long")).withColumn("run", F.floor(F.col("slot") / run_rows).cast("int"))
    return stage(ranked.select("doc_id", "size", "text_crc32", "cell", "shard", "slot", "run", *keep), "sharded", keep=True)


def run_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """shard, run, n and for each column its min_ and max_ in the run, as a file's statistics would have them."""
    return sharded.groupBy("shard", "run").agg(F.count("*").alias("n"), *(f(c).alias(f"{label}_{c}") for c in columns for label, f in (("min", F.min), ("max", F.max))))


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dims = [log_bin(F.octet_length(F.coalesce(F.col("text"), F.lit(""))), 4), name_bin(docs, "lang", 4), name_bin(docs, "source", 4)]
    out = shard_by_curve(docs, dims, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def oracle() -> str:
    """DuckDB SQL of op9; the curve's table is its text's longest part."""
    cells = ",".join(f"({code},{hilbert_index([code >> 8, code >> 4 & 15, code & 15], 4)})" for code in range(4096))
    crc = []
    for n in range(256):  # the reflected polynomial of crc32
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    return f"""
WITH curve(code, cell) AS (VALUES {cells}), names AS (
  SELECT 'lang' AS kind, lang AS name FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL
  SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY source
), ranges AS (
  SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS rank, greatest(count(*) OVER (PARTITION BY kind), 15) AS total FROM names
), bins AS (
  SELECT kind, name, dense_rank() OVER (PARTITION BY kind ORDER BY rank * 15 // total) AS bin FROM ranges
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS bytes, coalesce(l.bin, 0) AS lang, coalesce(s.bin, 0) AS source
  FROM documents LEFT JOIN bins l ON l.kind = 'lang' AND l.name = documents.lang LEFT JOIN bins s ON s.kind = 'source' AND s.name = documents.source
), h AS (
  SELECT hex(encode(text)) AS h, text, {crc}::BIGINT[] AS t FROM (SELECT DISTINCT text FROM d)
), crc AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS text_crc32 FROM h
), r AS (
  SELECT d.*, cell, row_number() OVER (ORDER BY cell, md5(text), md5(CAST(doc_id AS VARCHAR)), doc_id NULLS LAST) - 1 AS rank, count(*) OVER () AS total
  FROM d JOIN curve ON code = least(CAST(floor(log2(greatest(bytes, 1))) AS INTEGER), 15) * 256 + lang * 16 + source
), s AS (
  SELECT *, ((rank + 1) * 8 - 1) // total AS shard FROM r
)
SELECT doc_id, bytes + 1 AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, rank - shard * total // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(cell AS INTEGER) AS cell FROM s JOIN crc USING (text)
"""


