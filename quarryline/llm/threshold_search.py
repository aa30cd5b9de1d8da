"""Exact top-k inner product search by Fagin's threshold algorithm.

Candidates are dealt to blocks by a hash of their id, and each block keeps one sorted list per
dimension. A query reads its lists from the end that its sign favours, in rounds of doubling depth, from the
first on that could be its last. A row
is scored when a list first shows it. After a round no unseen row can score more than the query's
inner product with the values at that depth; once this bound is below the k-th best score, the query
stops. A block's answers are exact, so the k best of all blocks' answers are exact too.

The k-th best score that a query has in its own first block is a floor for all others: a block whose
bound is below it at the first entries is not read at all.

Blocks of queries meet blocks of candidates, each pair in a group of bounded size; no row is ever
compared in a task that holds a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import scratched, stage, table

BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 4096, 8192, 8
#: Depth of the first round, and queries that go through the rounds together.
FIRST_DEPTH, TOGETHER = 4, 256
LONG = 1 << 63
#: Digits that a score beyond the range of long is written with.
DIGITS = 700


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a double, which is then a whole number; null if the vector is null or
    a component is null or not finite. A product beyond the range of double is its largest number."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    most = 1.7976931348623157e308
    product = lambda v: F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most))
    # doubles from 2**52 on are whole, and floor gives a long
    whole = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)
    return F.when(fine, F.transform(F.transform(x, product), whole))


def exact_dtype(q: np.ndarray, x: np.ndarray):
    """A type in which all the products and their sums are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def whole_numbers(a: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) if kind is object else a.astype(kind)


def best(scores: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
    """Marks the k best seen entries of each row, ties to the left."""
    none = scores.min(initial=0) - 1 if scores.dtype == object else -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
    scores = np.where(seen, scores, none)
    n = scores.shape[1]
    if n <= k:
        return seen
    kth = np.partition(scores, n - k, 1)[:, n - k : n - k + 1]
    above, level = seen & (scores > kth), seen & (scores == kth)
    return above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))


def threshold_topk(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k_best: int, floor: np.ndarray | None = None):
    """For each query (row of q with id own) the k_best best rows of x by inner product, ties to smaller id,
    rows of the query's own id left out. Rows that score less than the query's floor need not be there.
    ids is sorted. Gives query numbers, row numbers, scores, and by query how many rows were scored."""
    kind = exact_dtype(q, x)
    q, x = whole_numbers(q, kind), whole_numbers(x, kind)
    n = len(x)
    order = np.argsort(-x, axis=0, kind="stable")
    down = np.take_along_axis(x, order, 0)  # the lists, best first for a positive weight
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], 0)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    signs = np.concatenate([plus > 0, minus < 0], 1).astype(np.float32)
    mine = own[:, None] == ids[None, :]
    seen, scores = np.zeros((len(q), n), bool), np.zeros((len(q), n), kind)
    lowest = np.full(len(q), -np.inf) if floor is None else floor
    # rounds double the depth, up to where the lists read are four times the rows; then all rows are
    depths = [d for d in (FIRST_DEPTH << k for k in range(40)) if d * x.shape[1] < 4 * n and d < n] + [n]
    # what a row not shown by a depth can score at most; the first one bounds all rows
    bounds = [plus @ down[d - 1] + minus @ down[n - d] for d in (1, *depths[:-1])]
    # no score is above this (Cauchy and Schwarz), so no round whose bound isn't below it can be a query's last
    norm = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(1))
    with np.errstate(over="ignore"):
        limit = norm(q) * norm(x).max() * (1 + 1e-9)
    useful = np.array([[bool(u) for u in (b < limit)] for b in bounds[1:]] + [[True] * len(q)])
    start = useful.argmax(0)
    active = np.flatnonzero(np.asarray(bounds[0] >= lowest, bool))
    for k, depth in enumerate(depths):
        now = active[start[active] <= k]
        if not len(now):
            continue
        if depth == n:
            fresh = ~seen[now]  # dimensions of weight 0 have no list to read, yet their rows count
        else:
            shown = np.concatenate([place < depth, place >= n - depth], 1).astype(np.float32)
            fresh = (signs[now] @ shown.T > 0) & ~seen[now]
        part = scores[now]
        if kind is not object and 20 * fresh.sum() < fresh.size:
            i, j = np.nonzero(fresh)
            part[i, j] = (q[now[i]] * x[j]).sum(1)
        else:
            part = np.where(fresh, q[now] @ x.T, part)
        scores[now] = part
        seen[now] |= fresh
        if depth < n and n > k_best:
            known = lowest[now].astype(object if kind is object else np.float64)
            good = seen[now] & ~mine[now]
            full = good.sum(1) >= k_best
            if full.any():
                filled = np.where(good[full], part[full], part.min() - 1)
                known[full] = np.maximum(known[full], np.partition(filled, n - k_best, 1)[:, n - k_best])
            active = np.setdiff1d(active, now[~np.asarray(bounds[k + 1][now] >= known, bool)])
    read = seen.sum(1)
    rows, cols = np.nonzero(best(scores, seen & ~mine, k_best))
    return rows, cols, scores[rows, cols], read


def score_columns(scores: np.ndarray) -> tuple[list[int], list[str | None]]:
    """Scores as longs, held at the ends of their range, and for those at an end a text that orders them."""
    out, over = [], []
    for s in map(int, scores):
        out.append(min(max(s, -LONG), LONG - 1))
        over.append(None if -LONG < s < LONG else f"{s:0{DIGITS}d}" if s > 0 else f"{10**DIGITS + s:0{DIGITS}d}")
    return out, over


@scratched
def topk(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, scored for the k best candidates of each query.

    Both tables have vec_id long and v, an array of doubles that are whole numbers (or of longs below 2**53),
    null where the vector takes no part; a query meets candidates of its own number of dimensions, of none
    too. Candidates with the query's id are left out. All rows with one id count as candidates; queries that
    repeat an id and vector are one. Ties go to the smaller id. A row without an id is a candidate, whose
    ties come last, with a null vec_id, and no query. Scores are exact; one beyond the range of long is
    ranked by its value and given as the range's end. An empty table gives no rows; columns of other names
    are ignored. Vectors of any length do, as long as BLOCK of them fit in a task. scored is the share of
    the rows of that row's block which were scored for the query.
    """
    queries = queries.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", F.col("v").cast("array<double>").alias("v")).distinct()
    candidates = candidates.filter(F.col("v").isNotNull()).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    blocks = max(LEAST_BLOCKS, -(-candidates.count() // block))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    # rows without an id are dealt by their vectors
    mine = F.pmod(F.when(F.col("vec_id").isNull(), F.xxhash64("v")).otherwise(F.xxhash64("vec_id", F.lit(1))), F.lit(blocks)).cast("int")
    left = candidates.select("vec_id", "v", F.size("v").alias("d"), mine.alias("c"))
    right = queries.select(F.col("vec_id").alias("own"), F.col("v").alias("w"), F.xxhash64("v").alias("h"), F.size("v").alias("d"), deal(2, query_blocks).alias("q"), deal(3, blocks).alias("home"))

    def vectors(t: pa.Table, name: str) -> np.ndarray:
        flat = pa.concat_arrays([x.flatten() for x in t.column(name).chunks]).to_numpy()
        return flat.reshape(t.num_rows, len(flat) // t.num_rows)

    def search(cand: pa.Table, query: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if cand.num_rows and query.num_rows:
            # by id, null last
            cand = cand.sort_by([("vec_id", "ascending")])
            x, q = vectors(cand, "v"), vectors(query, "w")
            ids = cand.column("vec_id").combine_chunks()
            # no query's own id is null, so any number that is none of theirs stands in
            own, h = query.column("own").to_numpy(), query.column("h").to_numpy()
            free = next(v for v in range(-1, -len(own) - 2, -1) if v not in set(own.tolist()))
            numbers = ids.fill_null(free).to_numpy()
            floor = query.column("floor").to_numpy() if "floor" in query.column_names else np.full(len(q), -np.inf)
            limit = np.sqrt(2.0**53 / max(x.shape[1], 1))
            large_x, large_q = (np.abs(x).max(1, initial=0) >= limit), (np.abs(q).max(1, initial=0) >= limit)
            # the few vectors of huge numbers, if any, go by themselves, as their products need wide types
            for i in (np.flatnonzero(~large_q), np.flatnonzero(large_q)):
                for j in (np.flatnonzero(~large_x), np.flatnonzero(large_x)):
                    for at in range(0, len(i) if len(j) else 0, TOGETHER):
                        some = i[at : at + TOGETHER]
                        row, col, score, read = threshold_topk(q[some], own[some], x[j], numbers[j], k, floor[some])
                        value, over = score_columns(score)
                        cols = [pa.array(own[some][row]), pa.array(h[some][row]), ids.take(pa.array(j[col])), pa.array(value, pa.int64()), pa.array(over, pa.string()), pa.array(read[row] / len(j))]
                        out.append(pa.table(cols, FOUND.names))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    def found(query: DataFrame, cand: DataFrame) -> DataFrame:
        return cand.groupBy("d", "q", "c").cogroup(query.groupBy("d", "q", "c")).applyInArrow(search, "query_id long, h long, vec_id long, score long, over string, scored double")

    best_first = [F.col("score").desc(), F.col("over").desc_nulls_last(), F.col("vec_id").asc_nulls_last()]
    order = Window.partitionBy("query_id", "h").orderBy(*best_first)
    # a floor is a double below the k-th score of the query's own block
    home = found(right.withColumn("q", F.lit(0)).withColumnRenamed("home", "c"), left.withColumn("q", F.lit(0)))
    kth = home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).filter("over is null")
    kth = stage(kth.select(F.col("query_id").alias("own"), "h", (F.col("score").cast("double") - F.abs("score") * 1e-12 - 1).alias("floor")), "floors")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = right.drop("home").join(kth, ["own", "h"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).withColumn("c", every(blocks))
    out = found(right, left.withColumn("q", every(query_blocks)))
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")
    return stage(out, "nearest", keep=True)


FOUND = pa.schema([("query_id", pa.int64()), ("h", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.string()), ("scored", pa.float64())])


def op1_threshold_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", 64).alias("v"))
    return topk(rows, rows.filter(F.col("vec_id") % 20 == 0), 20).drop("scored")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.x) = 0 THEN 0 ELSE CAST(list_dot_product(q.x, c.x) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
