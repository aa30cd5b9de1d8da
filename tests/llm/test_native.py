"""Chat formatting, sharding, mixing and line dedup against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import chat_format, curriculum_mix, hilbert_shards, line_dedup

TURNS = "conv_id long, turn long, role string, text string, messages int, formatted string"


def brute_turns(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in out.items()}


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]", 1, "x"), (1, 1, "assistant", "a<|b|>c &lt; &amp;lt; <<SYS>>", 1, "x"), (1, 2, "assistant", None, 1, "x"), (1, 3, "user", "x" * 50_000, 1, "x"),
        (2, 0, "user", "", 1, None), (2, 0, "user", "", 1, None), (None, None, None, None, None, None), (3, None, "assistant", "|>", 1, "x"), (3, 1, "a|>b", "&|>&", 1, "x"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in chat_format.parsed(chat_format.formatted(df)).collect()}
    for conv, turns in brute_turns(rows).items():
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        said = [t for role, t in turns if role == "assistant"]
        assert r["loss_text"] == "".join(said)
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(spans) == len(said) and all(("<|" in t) or s.startswith(t[:1]) or "&" in s for s, t in zip(spans, said))
    merged = chat_format.messages(df).filter("conv_id = 1").first()["messages"]
    assert [m["role"] for m in merged] == ["user", "assistant", "user"] and len(merged[1]["texts"]) == 2
    digest = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    assert digest[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in brute_turns(rows)[1]).encode()).hexdigest()
    assert chat_format.digests(df.limit(0)).count() == 0


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>|/s[]INST&ampltvb;+ \\$x", max_size=30), min_size=1, max_size=20))
def test_escape_reverses(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = df.select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect()
    for r in out:
        assert r["t"] == r["u"]
        assert not any(c in r["e"] for c in ("</s>", "<|", "|>", "[INST]", "[/INST]", "<s>", "<<SYS>>"))


@pytest.mark.parametrize("bits,dims", [(1, 2), (2, 3), (3, 2), (4, 3)])
def test_hilbert_visits_neighbours(bits, dims):
    side = 1 << bits
    points = {hilbert_shards.hilbert_index(p, bits): p for p in ([n // side**d % side for d in range(dims)] for n in range(side**dims))}
    assert sorted(points) == list(range(side**dims))
    assert all(sum(abs(a - b) for a, b in zip(points[k], points[k + 1])) == 1 for k in range(len(points) - 1))


def names_binned(values, bits):
    """Place of each name among equal ranges of the distinct ones, in code point order; null is 0."""
    names, most = sorted({v for v in values if v is not None}, key=lambda v: [ord(c) for c in v]), (1 << bits) - 1
    ranges = [k * most // max(len(names), most) for k in range(len(names))]
    return {n: 1 + sorted(set(ranges)).index(r) for n, r in zip(names, ranges)} | {None: 0}


def brute_shards(docs, shards, bits=4):
    """(doc_id, size, crc32, cell, shard, slot) by one sort of all rows."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    lang, source = (names_binned([d[k] for d in docs], bits) for k in (2, 3))
    keyed = []
    for doc, text, a, b in docs:
        raw = (text or "").encode()
        size = min(max(len(raw), 1).bit_length() - 1, (1 << bits) - 1)
        cell = hilbert_shards.hilbert_index([size, lang[a], source[b]], bits)
        keyed.append(((cell, md5(text or ""), md5("" if doc is None else str(doc)), doc is None, doc or 0, len(raw)), (doc, len(raw) + 1, zlib.crc32(raw), cell)))
    keyed.sort(key=lambda x: x[0])
    out, n = [], len(keyed)
    for rank, (_, row) in enumerate(keyed):
        shard = ((rank + 1) * shards - 1) // n
        out.append((*row, shard, rank - shard * n // shards))
    return out


def dims_of(df):
    return [hilbert_shards.log_bin(F.octet_length(F.coalesce("text", F.lit(""))), 4), hilbert_shards.name_bin(df, "lang", 4), hilbert_shards.name_bin(df, "source", 4)]


COLUMNS = ("doc_id", "size", "text_crc32", "cell", "shard", "slot")


@pytest.mark.parametrize("bucket", [3, 4096])
def test_shards(spark, odd, none, bucket):
    # text that a third of the rows have, so that it alone fills many buckets
    many = [(1000 + k, "the same again" if k % 3 == 0 else f"text {k % 20}", "en", f"s{k % 40}") for k in range(120)]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(many, "doc_id long, text string, lang string, source string"))
    rows = [tuple(r) for r in docs.collect()]
    got = hilbert_shards.shard_by_curve(docs, dims_of(docs), 8, bucket_rows=bucket).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(brute_shards(rows, 8))
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    assert hilbert_shards.shard_by_curve(none, dims_of(none), 8).count() == 0
    extra = hilbert_shards.shard_by_curve(odd.withColumn("cell", F.lit("x")).withColumn("shard", F.lit(None).cast("int")), dims_of(odd), 8).count()
    assert extra == odd.count()


def test_runs_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hilbert_shards.shard_by_curve(docs, dims_of(docs), 8, run_rows=16, keep=("lang", "source"))
    runs = hilbert_shards.run_bounds(out, ["size", "lang", "source"]).collect()
    assert sum(r["n"] for r in runs) == docs.count() and max(r["n"] for r in runs) == 16
    hit = lambda c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in runs) / len(runs)
    assert hit("lang", "es") < 0.5 and hit("size", 40) < 0.5 and hit("source", "src3") < 0.5


def test_shards_of_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = hilbert_shards.op9_hilbert_shards(spark, sf).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(brute_shards(docs, 8))


def brute_targets(sizes, weights, repeats):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(odd, none):
    rows = curriculum_mix.mix(odd, [1, 2, 3]).collect()
    assert len(rows) == odd.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes, [1, 2, 3], 3)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) == -(-r["taken"] // r["size"]) if r["size"] else r["positions"] == []
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1
    assert curriculum_mix.mix(none, [1, 2, 3]).count() == 0


@pytest.mark.parametrize("knots", curriculum_mix.RAMPS + [[(0.0, 0.0), (0.3, 2.0), (1.0, 0.0)]])
def test_inverse_of_the_integral(spark, knots):
    import numpy as np

    t = np.linspace(0, 1, 20001)
    w = np.interp(t, [k for k, _ in knots], [v for _, v in knots])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    shares = [k / 40 for k in range(40)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", curriculum_mix.invert(F.col("s"), knots).alias("t"))
    for r in df.collect():
        assert np.interp(r["t"], t, area / area[-1]) == pytest.approx(r["s"], abs=1e-6)


def test_curriculum_is_sorted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = curriculum_mix.mix(docs, [1, 2, 3], whole=True)
    out = curriculum_mix.curriculum(mixed, 4).select("position", F.spark_partition_id().alias("p")).collect()
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    per = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["target"]) <= r["most"] for r in per)
    again = {(r["doc_id"], r["taken"]) for r in curriculum_mix.mix(docs.repartition(7), [1, 2, 3], whole=True).select("doc_id", "taken").collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in mixed.select("doc_id", "taken").collect()}


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute_lines(docs):
    """Kept texts by (id, text), the earliest line of each near group standing."""
    def words(line):
        return tuple(line.encode().split())

    places, texts = {}, {}
    order = sorted({(d is None, d or 0, h, t) for d, t, h in docs if t is not None})
    for rank, (null, d, h, t) in enumerate(order):
        for pos, line in enumerate(t.split("\n")):
            if len(words(line)) >= line_dedup.MIN_WORDS:
                places.setdefault(words(line), (rank, pos))
    out = {}
    for rank, (null, d, h, t) in enumerate(order):
        kept = []
        for pos, line in enumerate(t.split("\n")):
            w = words(line)
            gone = len(w) >= line_dedup.MIN_WORDS and places[w] < (rank, pos)
            if not gone and len(w) >= line_dedup.MIN_WORDS:
                gone = any(first < places[w] and abs(len(v) - len(w)) <= 1 and edits(v, w) <= 1 for v, first in places.items())
            if not gone:
                kept.append(line)
        out[(None if null else d, t)] = "\n".join(kept)
    return out


def check_lines(df):
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    docs = [(r["doc_id"], r["text"], hashes[r["text"]]) for r in df.select("doc_id", "text").collect()]
    want = brute_lines(docs)
    got = line_dedup.dedup_lines(df.withColumn("was", F.col("text"))).select("doc_id", "was", "text", "n_lines", "removed").collect()
    assert len(got) == len(docs)
    for r in got:
        if r["was"] is None:
            assert r["text"] is None and r["n_lines"] == 0
        else:
            assert r["text"] == want[(r["doc_id"], r["was"])]
            assert r["n_lines"] == r["was"].count("\n") + 1


def test_lines_of_odd_rows(odd, none):
    check_lines(odd)
    assert line_dedup.dedup_lines(none).count() == 0


def test_near_lines(spark):
    base = "a b c d e f g h i j"
    lines = [base, base + " k", "x " + base, base.replace("e", "E"), base.replace("e ", ""), "a b c X Y f g h i j", "p q r s", "p q r s", "p q r t", "p  q\tr s", "p q r s t", "q r s t", "q r t", "p q x s", "tiny", "tiny"]
    check_lines(spark.createDataFrame([(k, line) for k, line in enumerate(lines)] + [(50, "\n".join(lines))], "doc_id long, text string"))
    swap = [" ".join(f"w{j}" if j != k else "z" for j in range(12)) for k in range(12)]
    check_lines(spark.createDataFrame([(k, line) for k, line in enumerate(swap)], "doc_id long, text string"))


def test_lines_with_hot_keys(spark, odd, monkeypatch):
    from quarryline.llm import _common

    monkeypatch.setattr(_common, "LEAST_HOT", 2)
    lines = [f"one two three four w{k}" for k in range(20)] + ["the common line of all"] * 15 + [f"w{k} two three four five six" for k in range(12)]
    check_lines(spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string"))
    check_lines(odd)


def test_lines_of_documents(spark, sf):
    check_lines(spark.read.parquet(f"{sf}/documents.parquet").withColumn("removed", F.lit(1)))
