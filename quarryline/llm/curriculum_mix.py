"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], piecewise linear through knots. Its
demand for words up to t is target * I(t) / I(1), where I integrates the schedule. A document that
begins after c of its source's words is due when demand reaches c: t = I^-1(c / target * I(1)), which
within a knot segment is the root of a quadratic. Documents are range-sorted by that position. A
source that must give more words than it has begins again, so a document can have several positions.

Running sums take no task over a whole source: a source's documents are ordered by the hash of their
id, buckets are ranges of that hash, bucket sums are prefix-summed per source, and a window runs
inside (source, bucket) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ._common import WORD, scratched, stage, table

#: Knots (t, weight) by a source's place in the cycle; each integrates to 1 over [0, 1].
RAMPS = [[(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.5), (0.5, 1.5), (0.75, 0.5), (1.0, 0.0)]]


def integrate(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (area before, area, t0, w0, slope) of a schedule, scaled to a total area of 1."""
    knots = sorted(knots)
    if len(knots) < 2 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs two knots and no negative weight")
    parts = [(t0, w0, (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t1 > t0]
    total = sum(p[3] for p in parts)
    if total <= 0:
        raise ValueError("a schedule needs a positive weight")
    out, at = [], 0.0
    for t0, w0, slope, area in parts:
        out.append((at / total, area / total, t0, w0 / total, slope / total))
        at += area
    return out


def invert(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time t at which the schedule's integral reaches share of its total."""
    out = F.lit(float(sorted(knots)[-1][0]))
    for before, area, t0, w0, slope in reversed(integrate(knots)):
        if area <= 0:
            continue
        rest = F.greatest(share - before, F.lit(0.0))
        # rest = w0 u + slope u^2 / 2, solved without cancellation
        u = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(share < before + area, t0 + F.coalesce(F.when(rest <= 0, 0.0).otherwise(u), F.lit(0.0))).otherwise(out)
    return out


@scratched
def source_targets(sizes: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """source, source_size, place (in code point order, null last), weight, target.

    Targets share the total size by weight; none is above repeats * source_size, and what a cap frees
    is shared by weight among the rest: min(cap, level * weight) with the level that fills the total. The
    level rises from the total's even share until no more sources are capped; the driver sees two sums a step,
    and sources, however many, are ranked by ranges.
    """
    per = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    per = global_row_number(per, F.col("source").asc_nulls_last(), name="place").withColumn("place", F.col("place") - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")))
    per = stage(per.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight")), "source-caps")
    total, level, before = per.agg(F.sum("source_size").alias("n")).first()["n"] or 0, 0.0, -1.0
    while level > before:
        open_ = F.col("ratio") >= level
        r = per.agg(F.sum(F.when(~open_, F.col("cap"))).alias("cap"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        before, level = level, (total - (r["cap"] or 0.0)) / r["weight"] if r["weight"] else level
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.lit(float(level)) * F.col("weight")))
    return stage(per.select("source", "source_size", "place", "weight", target.alias("target")), "sources", keep=True)


def mix(docs: DataFrame, weights: list[float], repeats: int = 3, schedules: list[list[tuple[float, float]]] = RAMPS, whole: bool = False, buckets: int | None = None, name: str = "mix") -> DataFrame:
    """docs with size, source_size, target, taken and positions (array of training times, empty if not taken).

    size counts words (null text: 0). Weights and schedules go around the sources in code point order,
    null last. `taken` words of a document enter the mix, repeats counted; a source's first documents
    in hash order are taken once more than its others, and with whole=False the document at the edge
    is taken in part, so a source's words are its target rounded down. With whole=True documents enter
    whole: the one at the edge if at least half of it is due. Ties (equal ids) follow size and
    text hash; repeated rows count each. No rows, no result. An own column named as one of the new ones
    is replaced. Very long texts are counted whole. buckets: parts of a source; one for every 20,000
    documents, and 256 at least, if not given.
    """
    buckets = buckets or max(256, -(-docs.count() // 20_000))
    new = ("size", "source_size", "target", "taken", "positions")
    docs = docs.drop(*(c for c in new if c not in ("doc_id", "text", "source")))
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substr(md5, F.lit(1), F.lit(7)), 16, 10).cast("long") * buckets / (1 << 28)).cast("int")
    rows = docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_md5": md5, "_bucket": bucket, "_text": F.xxhash64("text")})
    narrow = rows.select("doc_id", "source", "size", "_bucket")
    sums = stage(narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("source_size")), f"{name}-sums")
    per = source_targets(sums, weights, repeats)
    inside = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_at", F.coalesce(F.sum("source_size").over(inside), F.lit(0))).drop("source_size")
    per = sums.join(per, sums["source"].eqNullSafe(per["source"])).select(sums["source"], "_bucket", "_at", "source_size", "place", "target")
    order = Window.partitionBy("source", "_bucket").orderBy("_md5", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_k", F.coalesce(F.sum("size").over(order), F.lit(0)))
    same = rows["source"].eqNullSafe(per["source"]) & (rows["_bucket"] == per["_bucket"])
    rows = rows.join(per, same).drop(per["source"]).drop(per["_bucket"]).withColumn("_before", F.col("_at") + F.col("_k"))
    words = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(F.lit(0))
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size"))
    if whole:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    times = F.least(full + F.when(part > 0, 1).otherwise(0), F.lit(repeats))
    rows = rows.withColumns({"taken": (full * F.col("size") + part).cast("long"), "_times": F.when(F.col("size") > 0, times).otherwise(0)})
    share = lambda i: (F.col("_before") + i * F.col("source_size")) / F.col("target")

    def due(i: Column) -> Column:
        out = invert(share(i), schedules[0])
        for n in range(1, len(schedules)):
            out = F.when(F.col("place") % len(schedules) == n, invert(share(i), schedules[n])).otherwise(out)
        return out

    seq = F.when(F.col("_times") > 0, F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.transform(seq, due))
    return rows.drop("_md5", "_bucket", "_text", "_k", "_at", "_before", "_times", "place")


def curriculum(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each time a document is due, range-sorted by `position`; documents not taken go.

    Equal positions follow the id; a sample of the positions sets the range bounds.
    """
    out = mixed.withColumn("position", F.explode("positions"))
    keys = ["position", F.col("doc_id").asc_nulls_last()]
    out = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    return out.sortWithinPartitions(*keys)


def op3_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs, [1, 2, 3])
    first = F.when(F.size("positions") > 0, F.get("positions", F.lit(0)))
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", F.round(first, 6).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, place % 3 + 1 AS weight, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / (place % 3 + 1) AS ratio FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, place, least(cap, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight) AS target FROM w
), r AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, place, target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_word,
    CAST(floor(target) AS BIGINT) // source_size AS full_times, CAST(floor(target) AS BIGINT) % source_size AS rest
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, full_times * size + least(greatest(rest - at_word, 0), size) AS taken, at_word / target AS share FROM r
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(CASE place % 3
    WHEN 0 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
    WHEN 1 THEN share
    ELSE CASE WHEN share < 0.75 / 1.0625 THEN share * 1.0625 / 1.5
      WHEN share < 1 / 1.0625 THEN 0.5 + 2 * (share * 1.0625 - 0.75) / (1.5 + sqrt(2.25 - 8 * (share * 1.0625 - 0.75)))
      ELSE 0.75 + 2 * (share * 1.0625 - 1) / (0.5 + sqrt(greatest(0.25 - 4 * (share * 1.0625 - 1), 0))) END
    END, 6) END AS position
FROM k
"""
