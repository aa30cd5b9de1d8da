"""Line deduplication across documents by a deletion-neighbourhood join, in DataFrame operations only.

A line is its sequence of words (white space is not compared). Two lines are near if one word inserted,
deleted or replaced makes them equal: an edit distance of EDITS = 1. A line's neighbourhood is the line
and its variants with one word deleted, as hashed keys. Near lines share a key: two lines that differ
in the word at i are equal without it, and a line with a word too many is the other without that
word. So a key need not be expanded into pairs: among the lines that lack the same i-th word all are
near each other, and the earliest stands for all of them; a line equal to another's variant is near it.
Every match with the earliest one is then verified on the words themselves.

Most lines have no near line at all. Near lines share their first or their last half, so only lines
which share such a half with a different line emit their neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_key, scratched, split_join, stage, table

EDITS = 1
#: Lines of fewer words stay, whatever repeats: one edit makes half of a line of two words another.
MIN_WORDS = 4
#: A table of at most so many rows is broadcast once counted, tens of MB; a larger one is joined by a
#: shuffle. Eight list elements weigh as a row.
BROADCAST_ROWS = 500_000


def words_of(line: Column) -> Column:
    """The words of a line; splitting at one plain character needs no regular expression."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def half(n: Column) -> Column:
    """The largest power of two that is no more than half of n words."""
    return F.pow(F.lit(2.0), F.floor(F.log2((n / 2).cast("int").cast("double")))).cast("int")


def half_keys(words: Column, n: Column, min_words: int) -> Column:
    """Hashes of the first and of the last words, as many as a near line with n, n - 1 or n + 1 words
    hashes too."""
    sizes = F.array_distinct(F.array(half(n), half(F.greatest(n - 1, F.lit(min_words)))))
    first = F.transform(sizes, lambda h: F.xxhash64(F.lit(0), h, F.slice(words, F.lit(1), h)))
    last = F.transform(sizes, lambda h: F.xxhash64(F.lit(1), h, F.slice(words, n - h + 1, h)))
    return F.concat(first, last)


def raw_lines(docs: DataFrame) -> DataFrame:
    """k, th (the document: its id and its text's hash), pos (from 0) and line."""
    # hashed before the lines are parted, else each line would carry and hash its whole text
    docs = docs.select(row_key().alias("k"), F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    return docs.select("k", "th", F.posexplode_outer("lines").alias("pos", "line"))


def lines_of(docs: DataFrame) -> DataFrame:
    """k, th, pos, words, n, h1 and h2 (the line's hash). Not filtered by n here, as Spark would split a
    line once for the filter and once for the rest."""
    rows = raw_lines(docs).select("k", "th", "pos", words_of(F.col("line")).alias("words"))
    return rows.withColumns({"n": F.size("words"), "h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")})


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """df, broadcast if a count of its rows proves that it is small; lists weigh by their lengths."""
    n = df.count() if weight is None else df.agg(F.sum(weight / 8 + 1)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def near(x: Column, y: Column) -> Column:
    """Whether two arrays of words are within one edit: all but one word match from either end."""
    same = lambda a, b: F.zip_with(a, b, lambda v, w: F.coalesce(v == w, F.lit(False)))
    run = lambda a, b: F.coalesce(F.nullif(F.array_position(same(a, b), F.lit(False)), F.lit(0)) - 1, F.greatest(F.size(a), F.size(b)))
    return run(x, y) + run(F.reverse(x), F.reverse(y)) >= F.greatest(F.size(x), F.size(y)) - EDITS


@scratched
def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, th, removed (positions): a line goes if an equal or near line comes earlier, by document id
    (null last), text hash and position. What removed the earlier line doesn't matter. Joins on a key that
    very many lines have (a common line, half or variant) leave its rows where they are."""
    if min_words < 2:
        raise ValueError("a line of one word has no half")
    place = F.struct("k", "th", "pos")
    t1 = stage(lines_of(docs).select("k", "th", "pos", "n", "h1", "h2", F.when(F.col("n") >= min_words, half_keys(F.col("words"), F.col("n"), min_words)).alias("keys")), "lines")
    t1 = t1.filter(F.col("n") >= min_words)
    classes = stage(t1.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")), "line-classes")

    keys = t1.select("h1", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("c")).filter("a <> b").select("key", "c")
    likely = split_join(keys, stage(shared, "shared-halves"), "key").select("h1").distinct()
    # one occurrence, the first, of each line that shares a half with another line
    firsts = stage(classes.join(likely, "h1", "left_semi").select("h1", "h2", "first.*"), "likely-lines")
    lines = raw_lines(docs).join(small(firsts), ["k", "th", "pos"]).dropDuplicates(["h1", "h2"])
    lines = stage(lines.select("h1", "h2", place.alias("first"), words_of(F.col("line")).alias("words")), "likely-words")

    n = F.size("w")
    i = F.col("i")
    # variants are hashed over the words' hashes, which are shorter than the words
    without = F.concat(F.slice("w", F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice("w", i + 1, F.greatest(n - i, F.lit(0))))
    spots = lines.select("h1", "h2", "first", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    spots = spots.select("h1", "h2", "first", "w", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    spots = spots.select("h1", "h2", "first", "i", F.when(i == 0, F.xxhash64("w")).otherwise(F.xxhash64(without)).alias("v"))
    spots = stage(spots, "variants")
    who = F.struct("first", "h1", "h2")
    # of each variant the earliest line that is it, and for each word left out the earliest that lacks it
    twice = stage(spots.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"), "variants-shared")
    spots = stage(split_join(spots, twice, "v").drop("c"), "neighbours")
    at_v = spots.groupBy("v").agg(F.min(F.when(i == 0, who)).alias("whole"), F.min(F.when(i > 0, who)).alias("cut"), F.count("*").alias("c"))
    spots = stage(split_join(spots, stage(at_v, "variants-first"), "v").drop("c"), "neighbours-first")
    at_i = stage(spots.filter("i > 0").groupBy("v", "i").agg(F.min(who).alias("w"), F.count("*").alias("c")).filter("c > 1"), "variants-by-place")
    by_i = split_join(spots.filter("i > 0").select("v", "i", "h1", "h2", "first"), at_i, ["v", "i"]).select("h1", "h2", "first", "w")
    by_v = spots.select("h1", "h2", "first", F.when(i == 0, F.col("cut")).otherwise(F.col("whole")).alias("w"))
    pairs = by_i.unionByName(by_v).filter(F.col("w.first") < F.col("first")).select("h1", "h2", F.col("w.h1").alias("g1"), F.col("w.h2").alias("g2")).distinct()
    pairs = stage(pairs, "line-pairs")
    other = lines.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("earlier"))
    other = stage(pairs.groupBy("g1", "g2").agg(F.count("*").alias("c")).join(other, ["g1", "g2"]), "earlier-lines")
    pairs = split_join(pairs, other, ["g1", "g2"]).drop("c").join(lines.select("h1", "h2", "words"), ["h1", "h2"])
    close = pairs.filter(near(F.col("words"), F.col("earlier"))).select("h1", "h2", F.lit(True).alias("near")).distinct()

    gone = classes.join(close, ["h1", "h2"], "left").filter("c > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "c")
    gone = split_join(t1.select("k", "th", "pos", "h1", "h2"), stage(gone, "lines-gone"), ["h1", "h2"]).filter(F.col("near") | (place != F.col("first")))
    return stage(gone.groupBy("k", "th").agg(F.sort_array(F.collect_set("pos")).alias("removed")), "removed-lines", keep=True)


ADDED = ("n_lines", "removed")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, each text without its lines that repeat or nearly repeat an earlier one, plus n_lines (lines
    before, null text: 0) and removed (positions of the lines that went), in place of own columns
    named so.

    Lines are parted by line feeds. Lines of fewer than min_words words stay; of all others an exact repeat goes
    as well as a near one. A null text stays null; a
    text all of whose lines went is empty. Rows that repeat an id and text are one document and get one
    result; rows that repeat only the id are told apart by their texts. Other columns stay.
    """
    docs = docs.drop(*ADDED)
    gone = removed_lines(docs, min_words).select(F.col("k").alias("_k"), F.col("th").alias("_th"), F.col("removed").alias("_removed"))
    out = docs.withColumns({"_row": row_key(), "_text": F.xxhash64("text")})
    out = out.join(small(gone, F.size("_removed")), (F.col("_row") == F.col("_k")) & (F.col("_text") == F.col("_th")), "left")
    out = out.withColumn("_lines", F.when(F.col("_removed").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed")), lambda i: F.get("_lines", i))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = out.withColumns({"n_lines": n, "removed": F.coalesce("_removed", F.array().cast("array<int>")), "text": text})
    return out.select(*docs.columns, *ADDED)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("n_lines").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, string_split_regex(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
), d AS (
  SELECT array_to_string(w, ' ') AS line, any_value(w) AS w, min((doc_id * 1000000 + pos)) AS first FROM l WHERE len(w) >= 4 GROUP BY 1
), n AS (
  SELECT line, first, w, unnest(range(0, len(w) + 1)) AS i FROM d
), v AS (
  SELECT line, first, i, CASE WHEN i = 0 THEN line ELSE array_to_string(list_concat(w[1:i - 1], w[i + 1:len(w)]), ' ') END AS v FROM n
), g AS (
  SELECT line, first, i, min(first) OVER (PARTITION BY v, i) AS same, min(CASE WHEN i = 0 THEN first END) OVER (PARTITION BY v) AS whole,
    min(CASE WHEN i > 0 THEN first END) OVER (PARTITION BY v) AS cut FROM v
), close AS (
  SELECT DISTINCT line FROM g WHERE (i > 0 AND (same < first OR whole < first)) OR (i = 0 AND cut < first)
), gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN d ON d.line = array_to_string(l.w, ' ') LEFT JOIN close c ON c.line = d.line
  WHERE c.line IS NOT NULL OR d.first <> l.doc_id * 1000000 + l.pos
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
  coalesce(string_agg(CAST(gone.pos AS VARCHAR), ',' ORDER BY gone.pos) FILTER (WHERE gone.pos IS NOT NULL), '') AS removed,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '')) AS text_md5
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id
"""
