"""Exact Jaccard join on word shingles by prefix filters under several global token orders.

Two sets with a Jaccard similarity of 3/4 or more have at least 3/4 of either set in common, so under
any one order of all tokens their first quarters (and one token) meet. Three orders are used, each
filter on what the one before has left:

1. By hash. All documents are indexed by a prefix that is a sixteenth of the set longer, so partners
   meet in that many tokens of it; documents that share fewer with any others are out.
2. By document frequency among those left, rarest first, on whole sets. A document whose rare quarter
   nobody shares is out; the others meet candidates in buckets of one token.
3. By another hash. A candidate pair must share prefix tokens under the orders 1 and 3 too before its
   sets are intersected.

Equal sets are one class, compared once. Buckets aren't expanded into pairs: a bucket's members meet its
most central member, links make components, and only members of a bucket that are then still in different
components meet each other, those of its largest component excepted among themselves. So no pair is left
out that could join two components. Members of small buckets meet by a join. Those of large ones are
dealt into blocks of bounded size, and each pair of blocks gives its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import clipped_batches, only_cache, row_key, scratched, small_batches, split_join, stage, table, tidied
from ._graph import components

WORDS = 5
REMEMBERED = 200_000
#: As in line_dedup: a counted table of no more rows is broadcast, a larger one joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets of more members are compared in blocks, of so many sets and tokens.
SMALL_BUCKET, BLOCK_SETS, BLOCK_TOKENS = 48, 128, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finalizer of splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """Hashes of words; forgets all when REMEMBERED are there, as a hash is soon made again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text's words, A-Z lower-cased; fewer words
    than a shingle has are one together."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ w[k : len(w) - size + 1 + k])
    return np.unique(out.view(np.int64))


def needed(n):
    """Tokens that a partner shares with a set of n: 3/4 of them, rounded up."""
    return (3 * n + 3) // 4


def signature(tokens: np.ndarray) -> tuple[int, int]:
    x = tokens.view(np.uint64)
    with np.errstate(over="ignore"):
        a, b = mixed(x).sum(dtype=np.uint64), mixed(x ^ _MIX[2]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sets(docs: DataFrame, whole: bool) -> DataFrame:
    """d (the id), k, th (the text's hash), n, s1, s2 (signature) and tokens: whole sets, or the prefixes of the
    first order. A text's sets are made in one task, whatever its length."""

    def run(batches):
        hashes = only_cache("hashes", WordHashes)
        for big in batches:
            for batch in clipped_batches(big, 4 << 20):
                n, s1, s2, tokens = [], [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    x = shingles(text, hashes)
                    a, b = signature(x)
                    n.append(len(x))
                    s1.append(a)
                    s2.append(b)
                    tokens.append(x if whole else x[: len(x) - needed(len(x)) + max(1, len(x) // 16)])
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), batch.column("th"), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["d", "k", "th", "n", "s1", "s2", "tokens"])

    docs = small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("d"), row_key().alias("k"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(run), "d long, k long, th long, n int, s1 long, s2 long, tokens array<long>")


def met(rows: DataFrame) -> DataFrame:
    """rows (id, tokens) with only the tokens that another row has too; rows without any go, and tokens that
    a row repeats. A token that very many rows have stays out of the shuffle."""
    entries = rows.select("id", F.explode("tokens").alias("t"))
    shared = stage(entries.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1"), "shared-tokens")
    return split_join(entries, shared, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("c").alias("df"), "t"))).alias("met"))


def first_quarter(x: np.ndarray) -> np.ndarray:
    """A set's prefix under the first order; sets are kept in it."""
    return x[: len(x) - needed(len(x)) + 1]


def third_quarter(x: np.ndarray) -> np.ndarray:
    """A set's prefix under the third order."""
    p = len(x) - needed(len(x)) + 1
    return x[np.argpartition(mixed(x.view(np.uint64)), p - 1)[:p]]


def list_slices(column) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    for prefix in (first_quarter, third_quarter):
        if not len(np.intersect1d(prefix(x), prefix(y), True)):
            return False
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets in full (id, tokens) are similar."""

    def run(batches):
        for big in batches:
            for batch in clipped_batches(big):
                keep = pa.array([similar(x, y) for x, y in zip(list_slices(batch.column("x")), list_slices(batch.column("y")))], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    x = full.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    y = full.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each of xs shares with each of ys."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    step = max(1, (1 << 24) // (len(xs) + len(ys)))
    for at in range(0, len(common), step):
        part = common[at : at + step]
        a, b = np.zeros((len(xs), len(part)), np.float32), np.zeros((len(ys), len(part)), np.float32)
        for rows, sets_ in ((a, xs), (b, ys)):
            for k, s in enumerate(sets_):
                place = np.minimum(np.searchsorted(part, s), len(part) - 1)
                rows[k, place[part[place] == s]] = 1
        out += a @ b.T
    return out


def links_of_blocks(t: pa.Table) -> pa.Table:
    """Links (a, b) between the sets of two blocks, or within one, of different components."""
    side = t.column("side").to_numpy()
    ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
    tokens = [x for c in t.column("tokens").chunks for x in list_slices(c)]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(two)
    two = one if within else two
    if not len(one):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    xs, ys = [tokens[k] for k in one], [tokens[k] for k in two]
    n, m = np.array([len(x) for x in xs])[:, None], np.array([len(y) for y in ys])[None, :]
    good = (label[one][:, None] != label[two][None, :]) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
    if within:
        good &= np.triu(np.ones_like(good), 1)
    for prefix in (first_quarter, third_quarter):
        if good.any():
            good &= shared_counts([np.sort(prefix(x)) for x in xs], [np.sort(prefix(y)) for y in ys]) > 0
    if good.any():
        both = shared_counts(xs, ys)
        good &= 100 * both >= 75 * (n + m - both)
    i, j = np.nonzero(good)
    a, b = ids[one][i], ids[two][j]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links_in_blocks(entries: DataFrame, full: DataFrame) -> DataFrame:
    """Links between members of large buckets (entries: t, id, n, label, main) of different components.

    Documents that such buckets hold together make a cluster. Those outside of some bucket's largest
    component (the others) meet each other and the rest; the rest don't meet among themselves.
    """
    least = stage(entries.groupBy("t").agg(F.min("id").alias("b"), F.count("*").alias("c")), "least-members")
    clusters = components(split_join(entries.select("t", F.col("id").alias("a")), least, "t").select("a", "b"), "clusters")
    docs = entries.groupBy("id").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.max(F.col("label") != F.col("main")).alias("other"))
    docs = stage(docs.join(clusters.select(F.col("node").alias("id"), "root"), "id"), "clustered")
    blocks = lambda when: F.greatest(F.ceil(F.count(F.when(when, 1)) / BLOCK_SETS), F.ceil(F.coalesce(F.sum(F.when(when, F.col("n").cast("long"))), F.lit(0)) / BLOCK_TOKENS)).cast("int")
    sizes = docs.groupBy("root").agg(blocks(F.col("other")).alias("p"), blocks(~F.col("other")).alias("q"))
    docs = docs.join(sizes, "root")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("p")).otherwise(F.col("q"))).cast("int")
    docs = docs.withColumn("mine", mine)
    key = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    mates = F.transform(upto("p"), lambda k: key("o", F.least(F.col("mine"), k), F.greatest(F.col("mine"), k), F.col("mine") > k))
    rests = F.transform(upto("q"), lambda k: key("r", F.col("mine"), k, F.lit(0)))
    others = F.transform(upto("p"), lambda k: key("r", k, F.col("mine"), F.lit(1)))
    dealt = docs.select("root", "id", "label", F.explode(F.when(F.col("other"), F.concat(mates, rests)).otherwise(others)).alias("key"))
    dealt = dealt.join(full.select("id", "tokens"), "id").select("root", "key.*", "id", "label", "tokens")
    return dealt.groupBy("root", "kind", "i", "j").applyInArrow(links_of_blocks, "a long, b long")


def links_between(buckets: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) enough to join all that similarity joins; buckets: t, id, n and m, the set's tokens
    that others have too. They bound what two sets can share."""
    fits = lambda n, m: (4 * F.least("n", n) >= 3 * F.greatest("n", n)) & (7 * F.least("m", m) >= 3 * (F.col("n") + F.col(n)))
    # the most central member has the least share of tokens of its own
    central = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("own"), F.col("id").alias("i"), F.col("n").alias("k"), F.col("m").alias("l"))
    pivot = stage(buckets.groupBy("t").agg(F.min(central).alias("p"), F.count("*").alias("c")).select("t", "p.*", "c"), "pivots")
    pairs = split_join(buckets, pivot, "t").filter((F.col("id") != F.col("i")) & fits("k", "l"))
    pairs = pairs.select(F.least("id", "i").alias("a"), F.greatest("id", "i").alias("b")).distinct()
    links = stage(verified(pairs, full), "star-links")

    comps = components(links, "labels")
    now = buckets.join(comps.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    now = stage(now, "labelled-buckets")
    per = now.groupBy("t", "label").agg(F.count("*").alias("c"))
    per = per.groupBy("t").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.count("*").alias("labels")).filter("labels > 1")
    per = stage(per.select("t", F.col("main.label").alias("main"), F.col("size").alias("c")), "mixed")
    now = stage(split_join(now, per, "t").withColumnRenamed("c", "size"), "mixed-buckets")
    few = now.filter(F.col("size") <= SMALL_BUCKET)
    x = few.filter("label <> main").select("t", F.col("id").alias("i"), F.col("n").alias("k"), F.col("m").alias("l"), F.col("label").alias("own"))
    once = (F.col("label") == F.col("main")) | (F.col("i") < F.col("id"))
    pairs = x.join(few, "t").filter((F.col("own") != F.col("label")) & fits("k", "l") & once)
    pairs = pairs.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct()
    links = links.unionByName(stage(verified(pairs, full), "small-links"))
    many = now.filter(F.col("size") > SMALL_BUCKET)
    if many.isEmpty():
        return links
    return links.unionByName(stage(links_in_blocks(many, full), "block-links"))


@scratched
def survivors(first: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n of the class representatives that share enough prefix tokens with others."""
    enough = F.size("met") >= F.greatest(F.lit(1), F.floor(F.floor((3 * F.col("n") + 3) / 4) / 16))
    sizes = classes.select("id", "n")
    left = met(first.select("id", "tokens")).join(sizes, "id").filter(enough)
    left = stage(left.select("id", "n", F.transform("met", lambda m: m["t"]).alias("tokens")), "met-all")
    # again among representatives only: copies met each other before
    return stage(met(left.select("id", "tokens")).join(sizes, "id").filter(enough).select("id", "n"), "survivors", keep=True)


@scratched
def links_and_components(buckets: DataFrame, full: DataFrame) -> DataFrame:
    """node and root of all members of buckets that similarity joins."""
    return stage(components(links_between(buckets, full), "groups"), "grouped", keep=True)


@scratched
def similar_rows(docs: DataFrame) -> DataFrame:
    """One row per document: d (its id), k (that, the largest long for a null one), th (its text's hash), n, root
    (names its component; null without shingles) and component (the least id of it, null without any)."""
    first = stage(sets(docs, whole=False).withColumn("id", F.monotonically_increasing_id()), "prefixes")
    classes = first.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.min("d").alias("least"), F.count("*").alias("c"))
    classes = stage(classes, "set-classes")
    left = survivors(first, classes)
    keyed = first.select("id", "k", "th", "s1", "s2").join(left, "id")
    ids = keyed.select("k", "th").distinct()
    near = docs.select("doc_id", "text").withColumns({"k": row_key(), "th": F.xxhash64("text")})
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    full = sets(near.join(ids, ["k", "th"], "left_semi"), whole=True).drop("d", "k", "th").dropDuplicates(["n", "s1", "s2"])
    full = stage(full.join(keyed.select("id", "n", "s1", "s2"), ["n", "s1", "s2"]).select("id", "n", "tokens"), "whole-sets")
    # the rarest quarter: tokens that nobody shares come first and fill it, then the rarest shared ones
    rare = met(full.select("id", "tokens")).join(full.select("id", "n"), "id")
    room = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1 - (F.col("n") - F.size("met"))
    rare = rare.withColumn("room", room.cast("int")).filter("room > 0")
    rare = rare.select("id", "n", F.size("met").alias("m"), F.explode(F.slice("met", F.lit(1), F.col("room"))).alias("e"))
    buckets = stage(rare.select(F.col("e.t").alias("t"), "id", "n", "m"), "buckets")
    comps = links_and_components(buckets, full)
    named = classes.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stage(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = stage(named.join(least, "root").select("n", "s1", "s2", "root", "component", "c"), "components-named")
    out = split_join(first.filter("n > 0").select("d", "k", "th", "n", "s1", "s2"), named, ["n", "s1", "s2"])
    bare = first.filter("n = 0").withColumns({"root": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    columns = ["d", "k", "th", "n", "root", "component"]
    return stage(out.select(columns).unionByName(bare.select(columns)), "similar-rows", keep=True)


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    A null text or one without words has no shingles, links with nothing and is its own component.
    Rows with equal sets link whatever their ids; repeated rows stay, each with its component. A null id
    sorts last, and stays null as a component's id if it has no other. No rows, no result; columns other
    than doc_id and text are ignored. Texts are read whole; each one's set must fit a task.
    """
    out = similar_rows(docs)
    component = F.when(F.col("root").isNull(), F.col("d")).otherwise(F.col("component"))
    return out.select(F.col("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM n
  UNION
  SELECT r.node, p.b FROM r JOIN p ON p.a = r.reached
), c AS (
  SELECT node, min(reached) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
