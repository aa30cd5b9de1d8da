"""Search, packing, the n-gram join, language ID, LM scoring and audio against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarryline.llm import _graph, bestfit_pack, language_id, lm_score, ngram_join, telephony_audio, threshold_search

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# search


def brute_topk(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_search(spark, block):
    rng = np.random.default_rng(0)
    vectors = [(k, [int(x) for x in rng.integers(-9, 10, 5)]) for k in range(150)]
    vectors += [(200 + k, list(vectors[3][1])) for k in range(30)] + [(300, [0] * 5), (301, [1, 2]), (302, [3, 4]), (303, []), (304, [])]
    df = spark.createDataFrame(vectors + [(400, None)], "vec_id long, v array<long>")
    queries = df.filter("vec_id % 20 = 0 or vec_id > 298")
    got = threshold_search.topk(df.withColumn("score", F.lit("x")), queries.union(queries), 20, block).collect()
    want = brute_topk(vectors, [v for v in vectors if v[0] % 20 == 0 or v[0] > 298], 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert threshold_search.topk(df.limit(0), queries, 5).count() == 0


@pytest.mark.parametrize("most", [1 << 12, 1 << 26, 1 << 34])
def test_search_of_large_numbers(spark, most):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.integers(-most, most, 8)]) for k in range(400)]
    if most == 1 << 34:
        vectors += [(1000, [64e200] + [1.0] * 7), (1001, [-64e200, 64e200] + [0.0] * 6), (1002, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    asked = [v for v in vectors if v[0] % 20 == 0 or v[0] > 999]
    whole = [(k, [int(x) for x in v]) for k, v in vectors]
    want = brute_topk(whole, [w for w in whole if w[0] in dict(asked)], 20)
    held = [(q, r, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, r, i, s in want]
    got = threshold_search.topk(df, df.filter("vec_id % 20 = 0 or vec_id > 999"), 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == held


def test_search_without_ids(spark):
    rows = [(0, [1.0, 2.0]), (None, [9.0, 9.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = threshold_search.topk(df, df.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, None, 27), (0, 3, 3), (0, None, 3), (20, 0, 0), (20, 3, 0), (20, None, 0)]


def test_search_stops_early():
    x = np.zeros((2000, 3), np.int64)
    x[:, 0] = np.arange(2000)
    q = np.array([[5, 0, 0]])
    _, ids, scores, read = threshold_search.threshold_topk(q, np.array([-1]), x, np.arange(2000), 10)
    assert sorted(ids) == list(range(1990, 2000)) and max(read) < 40
    # a floor that no row reaches: nothing is scored; one that some reach: those are there
    _, ids, _, read = threshold_search.threshold_topk(q, np.array([-1]), x, np.arange(2000), 10, np.array([1e6]))
    assert not len(ids) and max(read) == 0
    _, ids, _, _ = threshold_search.threshold_topk(q, np.array([-1]), x, np.arange(2000), 10, np.array([1995.0 * 5]))
    assert {1995, 1996, 1997, 1998, 1999} <= set(ids)


def test_search_scores_few_rows_of_skewed_dimensions():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(0, 1, (4000, 16)) * 1000 * 0.3 ** np.arange(16)).astype(np.int64)
    q = np.rint(rng.normal(0, 1, (40, 16)) * 1000 * 0.3 ** np.arange(16)).astype(np.int64)
    row, col, score, read = threshold_search.threshold_topk(q, np.full(40, -1), x, np.arange(4000), 5)
    for k in range(40):
        assert sorted(-score[row == k]) == sorted(-(q[k] @ x.T))[:5]
    assert read.mean() < 2000


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.01],), ([nan, 1.0],), ([inf],), ([None, 1.0],), (None,), ([],), ([1e200],), ([1.7e308],)]
    got = [r["v"] for r in spark.createDataFrame(rows, "e array<double>").select(threshold_search.quantised("e", 64).alias("v")).collect()]
    assert got == [[32, -1], None, None, None, None, [], [64e200], [1.7976931348623157e308]]


# packing


@pytest.mark.parametrize("seed", range(5))
def test_plan_packs_like_best_fit(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 10), 100, 51, 34]) for _ in range(400))
    used, ranks = {}, Counter()
    for length, rank, n, first, offset in bestfit_pack.plan(counts, 100):
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            used.setdefault(first + k, []).append((offset, length))
    assert ranks == counts
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - length)
    assert len(used) == len(rooms)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in odd.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = bestfit_pack.pack(odd, WORD_BPE).collect()
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        assert sorted(o for o, _ in spans) == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert bestfit_pack.pack(none, WORD_BPE).count() == 0


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    texts = ["It's   we'll 'S x!!y ?!\x1c! été ÉTÉ ΣΑΣ İ", "a b c <|endoftext|>x<|startoftext|> ​日本 123abc", "\x00 � \U0001f600!", "don't'll''s"]
    ids = bestfit_pack.WordIds(WORD_BPE)
    for text, raw in zip(texts, ids.texts([t.encode() for t in texts])):
        assert list(np.frombuffer(raw, "<u4")) == tok.encode(text, add_special_tokens=False).ids


# n-gram join


def brute_groups(rows):
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 63), 1 << 62 if doc is None else doc)
    return Counter((doc, len(sets[i]), None if least[root(i)] == 1 << 62 else least[root(i)]) for i, (doc, _) in enumerate(rows))


def check_groups(df):
    want = brute_groups([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df).collect())
    assert got == want


def test_groups_of_odd_rows(odd, none):
    check_groups(odd)
    assert ngram_join.similar_groups(none).count() == 0


def chained(spark, seed):
    """Chains of small edits, texts around the threshold, and a passage that many share."""
    rng, rows = random.Random(seed), []
    vocab = [f"v{k}" for k in range(3000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    for _ in range(6):
        text = [rng.choice(vocab) for _ in range(rng.choice([12, 40, 120]))]
        for _ in range(14):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.choice([3, 10, 11, 12, 60]))]) for _ in range(25)]
    rng.shuffle(rows)
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")


def test_groups_of_the_largest_id(spark):
    most = (1 << 63) - 1
    rows = [(most, "a b c d e f"), (None, "a b c d e f"), (most, "x y z"), (None, "p q"), (most - 1, None)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == Counter([(most, most, 2), (None, most, 2), (most, most, 1), (None, None, 1), (most - 1, most - 1, 0)])


def test_groups_with_hot_keys(spark, monkeypatch):
    from quarryline.llm import _common

    rng = random.Random(4)
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(k, f"{common} " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(60))) for k in range(60)]
    rows += [(100 + k, common + f" end{k % 3}") for k in range(40)] + [(200 + k, None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in ngram_join.similar_groups(df).collect())
    monkeypatch.setattr(_common, "LEAST_HOT", 3)
    assert sorted(tuple(r) for r in ngram_join.similar_groups(df).collect()) == plain == sorted((d, n, c) for d, n, c in brute_groups(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_chains(spark, seed):
    check_groups(chained(spark, seed))


@pytest.mark.parametrize("small", [0, 10**9])
def test_groups_by_blocks_or_joins(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    check_groups(chained(spark, 3))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}


# language ID


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.identify(docs.withColumn("lang_pred", F.lit("x")), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert sum(r["lang_rejected"] for r in rows) <= 0.01 * len(rows) and all(0 <= r["lang_score"] <= 1 for r in rows)
    other = language_id.identify(spark.createDataFrame([("Это совсем другой язык",), ("...!!! 123",), (None,)], "text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in other] == [False, True, True] and all(r["lang_rejected"] for r in other[1:])
    found = language_id.identify(odd, model)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    assert language_id.identify(none, model).count() == 0
    blank = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, blank).collect()} == {"und"}


def test_predictions_by_brute_force(spark, odd):
    """One text at a time from the model's numbers: its subwords by their definition, their mean, a softmax."""
    rows = odd.select("doc_id", "text").collect()
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    mask = (1 << 64) - 1

    def slow(text):
        sums, n = [0.0] * len(model.langs), 0
        for word in (text or "").lower().split():
            for run in "".join(c if c.isalpha() else " " for c in word).split():
                marked = f"<{run}>"
                for order in language_id.ORDERS:
                    for at in range(len(marked) - order + 1):
                        part = marked[at : at + order]
                        if part in "<>":
                            continue
                        h = 0
                        for c in part:
                            h = (h * 0x100000001B3 + ord(c)) & mask
                        bucket = ((h + order) * 0x9E3779B97F4A7C15 & mask) >> (64 - language_id.BITS)
                        sums, n = [a + b for a, b in zip(sums, model.scores[bucket])], n + 1
        if not n:
            return "und", 0.0
        z = [np.exp((a / n + b) / model.temperature) for a, b in zip(sums, model.bias)]
        return model.langs[int(np.argmax(z))], max(z) / sum(z)

    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["lang_score"], r["lang_rejected"]) for r in language_id.identify(odd.select("doc_id", "text"), model).collect()}
    for doc, text in rows:
        lang, score = slow(text)
        assert got[doc, text][0] == lang and got[doc, text][1] == pytest.approx(score, abs=1e-9) and got[doc, text][2] == (lang == "und" or score < model.threshold)


def test_sample_is_the_same_each_time(spark):
    rows = [(1, "the same text again and again", "en")] * 40 + [(k, f"other words number {'abc'[k % 3]}", "fr") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.sample(docs.repartition(n), 800, 30) for n in (1, 7))
    assert len(a) == 30 and [(x, y.tolist()) for x, y, _ in a] == [(x, y.tolist()) for x, y, _ in b]


def test_calibration_lowers_confidence_of_a_poor_model():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(["a", "b"]), np.array([1, 2, 3], "u2"), np.array([1, 1, 1], "f4")) for _ in range(200)]
    model = language_id.train(rows)
    p = model.probabilities(model.scores[[1, 2, 3]].mean(0)[None], np.ones(1))
    assert p.max() < 0.75


# LM scoring


def brute_base(rows, learn):
    c = Counter()
    for t in learn:
        c.update((t or "").encode().lower().split())
        c[b""] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for doc, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        out.append((doc, len(words), sum(c[w] > 0 for w in words), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words)))
    return out


def test_lm_base(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 50)
    learn = odd.filter("coalesce(doc_id, 0) <> 12")
    got = lm_score.score_texts(odd, learn, WORD_BPE).collect()
    want = brute_base([(r["doc_id"], r["text"]) for r in odd.collect()], [r["text"] for r in learn.collect()])
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])) for r in got)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.score_texts(none, learn, WORD_BPE).count() == 0
    blank = lm_score.score_texts(odd, none, WORD_BPE).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in blank)


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(1)
    counts = np.zeros(500)
    counts[:60] = np.arange(60, 0, -1) * 50
    # after an even id comes the next one; that is what there is to learn
    def text(n):
        out = []
        while len(out) < n:
            a = int(rng.integers(0, 30)) * 2
            out += [a, a + 1]
        return np.array(out[:n])

    sample = np.full((300, lm_score.CONTEXT + lm_score.STEP + 1), -2)
    for row in sample:
        row[: lm_score.CONTEXT + 1] = -1
        row[lm_score.CONTEXT + 1 :] = text(lm_score.STEP)
    return lm_score.train(counts, sample), text


def test_lm_is_a_distribution(trained):
    """Probabilities of all continuations of a text add up to one, the end included."""
    model, text = trained
    scorer = lm_score.Scorer(model)
    for n in (0, 3, 40):
        head = text(n) if n else np.zeros(0, int)
        z = scorer.inputs[lm_score.windows([head])[0]]
        steps, at = divmod(n, lm_score.STEP)
        total = 0.0
        def p(c, x):
            full = lambda v: np.full((1, lm_score.STEP), v)
            return np.exp(scorer.log_probabilities(z[steps : steps + 1], full(c), full(x))[0, at])  # noqa: B023

        clusters = model.members()
        for c in range(lm_score.SINGLES + lm_score.CLUSTERS + 1):
            if c in clusters:
                assert set(clusters[c][0]) == set(model.inputs[model.classes == c])
                total += sum(p(c, x) for x in clusters[c][0])
            elif c == 0 or (model.classes == c).any():
                total += p(c, 0) * ((10 ** model.inside[model.classes == c]).sum() if c else 1)
            else:
                total += p(c, 0)
        assert total == pytest.approx(1, abs=1e-4)


def test_lm_learns_and_scores_once(trained):
    model, text = trained
    scorer = lm_score.Scorer(model)
    texts = [text(n) for n in (1, 2, 31, 32, 33, 100, 0)]
    got = scorer.score(texts, most=2)
    for x, s in zip(texts, got):
        assert scorer.score([x])[0] == pytest.approx(s, abs=1e-3)
        slow = 0.0  # one token at a time
        z = scorer.inputs[lm_score.windows([x])[0]]
        for j in range(len(x) + 1):
            c = model.classes[x[j]] if j < len(x) else 0
            full = lambda v: np.full((1, lm_score.STEP), v)
            slow += scorer.log_probabilities(z[j // lm_score.STEP][None], full(c), full(model.inputs[x[j]] if j < len(x) else 0))[0, j % lm_score.STEP] / np.log(10)
            slow += model.inside[x[j]] if j < len(x) and c not in model.members() else 0
        assert slow == pytest.approx(s, abs=1e-3)
    ordered, shuffled = text(100), np.random.default_rng(3).permutation(text(100))
    assert scorer.score([ordered])[0] > scorer.score([shuffled])[0] + 10


def test_lm_by_brute_force(trained):
    """The formula of the module's docstring, a token at a time, from the model's parameters alone."""
    m, text = trained
    context, step = lm_score.CONTEXT, lm_score.STEP

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    def slow(ids):
        out, ends = 0.0, [*ids, None]
        for j, token in enumerate(ends):
            # a window begins CONTEXT inputs before its first target; inputs before the text are number 0
            first = j // step * step - context
            seen = [m.inputs[ids[k - 1]] if 0 < k <= len(ids) else 0 for k in range(first, j + 1)]
            x = np.stack([m.emb[z] + m.pos[p] for p, z in enumerate(seen)]).astype(np.float64)
            a = softmax((x[-1] @ m.wq) @ (x @ m.wk).T / np.sqrt(x.shape[1]))
            g = np.maximum((x[-1] + a @ (x @ m.wv)) @ m.w1 + m.b1, 0)
            c = 0 if token is None else m.classes[token]
            out += np.log10(softmax(g @ m.out + m.bias)[c])
            if token is None:
                continue
            if lm_score.SINGLES < c < lm_score.SINGLES + 1 + lm_score.CLUSTERS:
                own = [k for k in range(len(m.classes)) if m.classes[k] == c and m.inputs[k] > 1]
                z = np.array([g @ m.inner[m.inputs[k]] + m.inside[k] * np.log(10) for k in own])
                out += np.log10(softmax(z)[own.index(token)])
            else:
                out += m.inside[token]
        return out

    texts = [text(n) for n in (0, 1, 31, 32, 70)]
    assert lm_score.Scorer(m).score(texts) == pytest.approx([slow(list(x)) for x in texts], abs=1e-2)


def test_lm_beats_the_baseline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from quarryline.llm._common import fold

    got = lm_score.score_texts(docs, docs.filter(fold("doc_id", 7) != 2), WORD_BPE).withColumn("held", fold("doc_id", 7) == 2)
    s = got.filter("held").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    print("held out: model", s["s"], "baseline", s["b"])
    assert s["s"] > s["b"]


def test_lm_trains_on_when_all_logits_are_far_down(spark):
    """As long training leaves them: each row's exponentials are 0 in float32, and parameters that are no numbers
    overflow the sums over partitions."""
    counts = np.arange(50_000, 0, -1.0)
    inputs = lm_score.inputs_of(counts)
    classes, inside = lm_score.classes_of(counts, inputs, np.ones((lm_score.INPUTS, 2 * (lm_score.SINGLES + 2))))
    model = lm_score.untrained(inputs, classes, inside, np.bincount(classes, counts))
    model.bias -= 200
    model.inner -= 1000
    docs = spark.createDataFrame([(k, f"the sun shines on tree {k} and road {k} " * 40) for k in range(8)], "doc_id long, text string").repartition(2)
    got = lm_score.trained_on(docs, model, WORD_BPE, spark.sparkContext.broadcast(({}, {})), 0.01, 1, 64, False)
    assert all(np.isfinite(getattr(got, k)).all() for k in lm_score.PARAMETERS)
    assert not np.array_equal(got.inner, model.inner) and not np.array_equal(got.emb, model.emb)


def many_ids():
    """An untrained model with clusters, and windows of three texts, each with its end, in one batch."""
    rng, counts = np.random.default_rng(5), np.arange(400, 0, -1.0)
    inputs = lm_score.inputs_of(counts)
    classes, inside = lm_score.classes_of(counts, inputs, rng.random((lm_score.INPUTS, 2 * (lm_score.SINGLES + 2))))
    model = lm_score.untrained(inputs, classes, inside, np.bincount(classes, counts, lm_score.SINGLES + lm_score.CLUSTERS + 1))
    model.inner[:] = rng.normal(0, 0.3, model.inner.shape)
    return model, np.concatenate([lm_score.text_windows(rng.integers(0, 400, n)) for n in (20, 31, 50)])


@pytest.mark.parametrize("down", [0, 300])
def test_lm_gradient_by_differences(down):
    """Against differences of the mean loss by the formula of the module's docstring, in float64; also where
    all logits are so far down that their exponentials are 0 in float32."""
    model, sample = many_ids()
    model.bias -= down
    clusters, ends = model.members(), lm_score.CONTEXT
    log_softmax = lambda z: (z := z - z.max()) - np.log(np.exp(z).sum())

    def loss(p):
        out = []
        for row in sample:
            x = p["emb"][np.append(model.inputs, 0)[np.maximum(row[:-1], -1)]] + p["pos"]
            for j in range(ends, len(row) - 1):
                if row[j + 1] == -1 or (row[j + 1] == -2 and row[j] == -2):
                    continue
                a = log_softmax(x[j] @ p["wq"] @ (x[: j + 1] @ p["wk"]).T / np.sqrt(lm_score.DIM))
                g = np.maximum((x[j] + np.exp(a) @ (x[: j + 1] @ p["wv"])) @ p["w1"] + p["b1"], 0)
                c = 0 if row[j + 1] < 0 else model.classes[row[j + 1]]
                out.append(-log_softmax(g @ p["out"] + p["bias"])[c])
                if c in clusters:
                    own, share = clusters[c]
                    out[-1] -= log_softmax(p["inner"][own] @ g + share)[own.tolist().index(model.inputs[row[j + 1]])]
        return np.mean(out)

    trainer = lm_score.Trainer(model, 1)
    good, ids = lm_score.expected(sample), np.maximum(sample, -1)
    y = ids[:, 1 + lm_score.CONTEXT :]
    trainer.gradient(trainer.inputs[ids[:, :-1]], trainer.inputs[y], trainer.classes[y], good)
    at, rng = {k: v.astype(np.float64) for k, v in trainer.p.items()}, np.random.default_rng(2)
    for k, v in at.items():
        way = rng.normal(size=v.shape)
        want = (loss(at | {k: v + 1e-6 * way}) - loss(at | {k: v - 1e-6 * way})) / 2e-6
        assert (trainer.grad[k] * way).sum() == pytest.approx(want, rel=1e-2, abs=1e-3), k


def test_lm_is_a_distribution_with_rare_ids():
    """Rare ids, which the model does not tell apart, are a class of their own beside the clusters."""
    counts = np.arange(6000, 0, -1.0)
    inputs = lm_score.inputs_of(counts)
    classes, inside = lm_score.classes_of(counts, inputs, np.random.default_rng(5).random((lm_score.INPUTS, 2 * (lm_score.SINGLES + 2))))
    scorer = lm_score.Scorer(lm_score.untrained(inputs, classes, inside, np.bincount(classes, counts)))
    assert (inputs == 1).sum() > 1000 and not set(classes[inputs == 1]) & set(classes[inputs > 1])
    z, y, _, _ = lm_score.windows([np.array([k]) for k in range(6000)] + [np.zeros(0, int)])
    first = scorer.log_probabilities(scorer.inputs[z], scorer.classes[y], scorer.inputs[y])[:, 0] / np.log(10) + scorer.inside[y[:, 0]]
    assert (10.0**first).sum() == pytest.approx(1, abs=1e-3)


def test_lm_steps_make_no_large_arrays():
    """What a step needs is made once: a step's new arrays are small beside its logits (1.9 MB)."""
    model, sample = many_ids()
    trainer, batch = lm_score.Trainer(model, 1), np.resize(sample, (96, sample.shape[1]))
    trainer.fit(batch, 0.01)
    tracemalloc.start()
    trainer.fit(batch, 0.01)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20


def test_lm_learns_from_all_of_a_long_text(spark):
    rng, words = random.Random(4), "sun tree road blue fish door hand cold stone milk bird fire leaf rain gold ship".split()
    pairs = [w for _ in range(20_000) for k in [rng.randrange(8)] for w in words[2 * k : 2 * k + 2]]
    learn = spark.createDataFrame([(1, " ".join(pairs))], "doc_id long, text string")
    shuffled = rng.sample(pairs[:100], 100)
    docs = spark.createDataFrame([(1, " ".join(pairs[:100])), (2, " ".join(shuffled))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(docs, learn, WORD_BPE).collect()}
    assert got[1] > got[2] + 10


# audio


def test_codec_tables():
    assert telephony_audio.EXPAND["mulaw"][[0x00, 0x7F, 0x80, 0xFF, 0x0F]].tolist() == [-32124, 0, 32124, 0, -16764]
    assert telephony_audio.EXPAND["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def slow_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony_audio.STEPS[index])
            move = step >> 3
            move += step if code & 4 else 0
            move += step >> 1 if code & 2 else 0
            move += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(telephony_audio.MOVES[code])))
            out.append(value)
    return out


def test_adpcm_blocks():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (9, 192)).astype(np.uint8)
    got = telephony_audio.decode_adpcm(blocks)
    assert got.tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 8000
    pcm = np.rint(9000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    for up, down in ((2, 1), (1, 2), (3, 2)):
        out = telephony_audio.resample(pcm, up, down, telephony_audio.sinc_bank(up, down))
        want = 9000 * np.sin(2 * np.pi * 440 * np.arange(len(out)) * down / up / 8000)
        assert len(out) == -(-4000 * up // down) and np.abs(out[50:-50] - want[50:-50]).max() < 150


def test_media_round_trip(odd, none):
    rows = telephony_audio.store_texts(odd)
    got = telephony_audio.expand_media(rows, "media").collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())
    assert Counter((r["doc_id"], r["payload"][: r["n_bytes"]]) for r in got) == texts
    for r in got:
        assert len(r["payload"]) % 192 == 0 and len(r["payload"]) and set(r["payload"][r["n_bytes"] :]) <= {32}
        assert r["problem"] is None and zlib.crc32(r["pcm"]) == r["pcm_crc32"] and len(r["pcm"]) == 2 * r["samples"]
    assert {r["codec"] for r in got} == {"mulaw", "alaw", "adpcm"}
    assert telephony_audio.expand_media(telephony_audio.store_texts(none)).count() == 0


def test_broken_media(spark):
    good = telephony_audio.write_wav("mulaw", b"\xff" * 10)
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:-4]), (5, good.replace(b"\x07\x00\x01\x00", b"\x01\x00\x01\x00", 1))]
    got = {r["id"]: r for r in telephony_audio.expand_media(spark.createDataFrame(rows, "id int, media binary"), rate=8000).collect()}
    assert got[1]["samples"] == 10 and got[1]["problem"] is None
    assert got[2]["samples"] is None and got[2]["problem"] is None
    assert all(got[k]["problem"] and got[k]["pcm"] is None for k in (3, 4, 5))


def test_op7_digests(spark, sf):
    from quarryline.llm.telephony_audio import op7_telephony_audio

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_telephony_audio(spark, sf).collect():
        payload = texts[r["doc_id"]].ljust(max(-(-len(texts[r["doc_id"]]) // 192), 1) * 192)
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
