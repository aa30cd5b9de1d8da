"""The corpus pipeline: each stage against brute force on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quarryline.llm import language_id
from test_models import brute_groups
from test_native import brute_lines


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 !!", "en", "src1", 6), (9003, "", None, None, 0), (None, "The only one without an id, here for that reason.", None, "src2", 48)], docs.schema)
    now = docs.unionByName(odd)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "mix", "pack"]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, sf)
        kept = rows(out)
        seen[name] = rows(now), kept
        if name != "pack":
            assert out.columns == docs.columns
            now = spark.createDataFrame(kept, docs.schema)

    before, after = seen["language_id"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 5

    before, after = seen["line_dedup"]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(r["text"],) for r in before], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    want = brute_lines([(r["doc_id"], r["text"], hashes[r["text"]]) for r in before])
    want = Counter((d, t) for (d, _), t in want.items() if t.split())
    assert Counter((r["doc_id"], r["text"]) for r in after) == want and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["ngram_join"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {doc for doc, _, root in groups if doc == root}
    assert len(after) == len({r["doc_id"] for r in after})

    before, after = seen["mix"]
    assert Counter(map(str, (sorted(r.items()) for r in before))).keys() >= Counter(map(str, (sorted(r.items()) for r in after))).keys()
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3

    before, after = seen["pack"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    per = Counter()
    for r in after:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048 and len(per) <= -(-sum(per.values()) // 2048) + 2


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_repeated_ids_leave_one_document(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.similar_stage(spark, docs, "").collect()) == [1, 3]


def test_dissimilar_documents_that_share_an_id_or_have_none_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, texts[2]), (4, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[5] + " end"), (7, texts[5]), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.similar_stage(spark, docs, "").collect())
    assert got == Counter([(None, texts[0]), (None, texts[1]), (5, texts[2]), (4, texts[3]), (None, texts[4]), (7, texts[5]), (None, "")])


def test_unlabelled_table_is_rejected_whole(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert language_id.fit(docs).langs == [] and corpus_pipeline.language_stage(spark, docs, "").count() == 0


def test_a_stage_leaves_the_tables_of_others(spark, sf):
    from quarryline.llm import line_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    open_result = line_dedup.op10_line_dedup(spark, sf)
    corpus_pipeline.language_stage(spark, docs, sf).count()
    corpus_pipeline.similar_stage(spark, docs, sf).count()
    assert open_result.count() == docs.count()


def test_operators_remove_what_they_have_staged(spark, sf):
    import os

    from quarryline.llm import _common, line_dedup, ngram_join

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = os.path.dirname(_common.staged_path(spark, "x"))
    there = set(os.listdir(folder))
    line_dedup.dedup_lines(docs)
    ngram_join.similar_groups(docs)
    kinds = Counter(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - there)
    assert kinds == {"removed-lines": 1, "similar-rows": 1}
    with _common.scratch(spark):
        line_dedup.dedup_lines(docs)
    assert Counter(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - there) == kinds


def test_staging_returns_the_driver_s_memory(spark, monkeypatch):
    """A plan's freed blocks below one that is still held stay with the process unless they are trimmed."""
    import ctypes

    from quarryline.llm import _common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.free.argtypes, libc.memset.argtypes = ctypes.c_void_p, [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_int, ctypes.c_size_t]
    blocks = [libc.malloc(60_000) for _ in range(4000)]
    for b in blocks:
        libc.memset(b, 1, 60_000)
    for b in blocks[:-1]:
        libc.free(b)
    before = resident()
    _common.stage(spark.range(1), "trimmed")
    assert before - resident() > 150 << 20
    libc.free(blocks[-1])
    # the JVM has the command, and it is called without an error
    monkeypatch.setattr(_common, "Py4JError", ZeroDivisionError)
    _common.trim_driver(spark)
