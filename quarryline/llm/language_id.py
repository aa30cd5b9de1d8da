"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection.

A text is the mean of the embeddings of its subwords: character n-grams of its letter runs, with marks
at the runs' ends, hashed to buckets. Training reads a bounded sample of labelled rows; the workers
send each one's counts per bucket. Part of the sample sets a temperature and the rejection
threshold: the level below which only `miss` of its right answers lie.

As the model is linear up to the softmax, a word adds a fixed vector to a text's scores, which workers
remember per word.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, clipped_batches, fold, only_cache, small_batches, table, tidied, with_fields

BITS, DIM, ORDERS = 13, 16, (1, 2, 3, 4)
BUCKETS = 1 << BITS
#: Bound on the labelled rows that training reads, per language (in expectation) and in all.
PER_LANG, IN_ALL = 800, 6000
REMEMBERED = 150_000
UNKNOWN = "und"


_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def letter_runs(word: str) -> list[str]:
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of lower-case words, and the number of the word that each is of. Words'
    letter runs are laid out with marks around them, and n-grams within a run are hashed together."""
    runs, owner = [], []
    for k, word in enumerate(words):
        found = letter_runs(word)
        runs += found
        owner += [k] * len(found)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(f"<{'><'.join(runs)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    opens, marks = code == ord("<"), (code == ord("<")) | (code == ord(">"))
    run = np.cumsum(opens) - 1
    buckets, whose = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(code) - n + 1] * _PRIME + code[n - 1 :]
        if n in ORDERS:
            good = run[: len(h)] == run[n - 1 :]
            if n == 1:
                good &= ~marks
            at = np.flatnonzero(good)
            buckets.append((((h[at] + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
            whose.append(run[at])
    return np.concatenate(buckets), np.array(owner)[np.concatenate(whose)]


@dataclass
class Model:
    """langs, per-bucket scores (embedding times weights), bias, temperature, rejection threshold."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


class WordScores(Remembered):
    """Word to row of `table`: what the word adds to the scores, and its number of subwords."""

    def __init__(self, model: Model):
        super().__init__(REMEMBERED)
        self.model, self.table = model, np.zeros((0, len(model.langs) + 1))
        self.kept: list[int] = []  # rows of words that moved from the last generation

    def learn(self, words: set[str]) -> None:
        last, self.kept = self.table, []
        before = len(self)
        new = self.unknown(words)
        if len(self) - len(self.kept) < before:  # a generation began
            self.last, self.table = last, last[:0]
        if self.kept:
            self.table = np.concatenate([self.table, self.last[self.kept]])
        if not new:
            return
        buckets, whose = subwords(new)
        rows = [np.bincount(whose, self.model.scores[buckets, k], len(new)) for k in range(len(self.model.langs))]
        rows.append(np.bincount(whose, minlength=len(new)))
        self.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, np.stack(rows, 1)])

    def promote(self, word: str) -> None:
        self.kept.append(self.old[word])
        self[word] = len(self)

    def of(self, texts: list[str]) -> np.ndarray:
        """Sums over each text's words."""
        split = [t.lower().split() for t in texts]
        self.learn(set().union(*split))
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, words in enumerate(split):
            out[k] = self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0)
        return out


def sample(docs: DataFrame, per_lang: int = PER_LANG, in_all: int = IN_ALL) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """lang, buckets and counts of a hash sample of the labelled docs, in a fixed order.

    The driver counts rows per language (one row each) and collects `in_all` rows of BUCKETS counts
    at most. A language with no more than `per_lang` rows is taken whole.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    per_lang = min(per_lang, max(in_all // len(counts), 1))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(share)
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    picked = known.select("lang", "text", order.alias("order")).filter(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for whole in batches:
            for batch in clipped_batches(whole, 4 << 20):
                out = []
                for lang, text, order in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "order"))):
                    buckets, n = np.unique(subwords(text.lower().split())[0], return_counts=True)
                    out.append((lang, order, buckets.astype("<u2").tobytes(), n.astype("<f4").tobytes()))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "order", "buckets", "n"])

    rows = small_batches(picked).mapInArrow(tidied(run), "lang string, order long, buckets binary, n binary").filter("octet_length(buckets) > 0")
    # the first in this order, so that rows which repeat an id and text leave the sample the same in each run
    rows = rows.orderBy("order", "lang", "buckets", "n").limit(in_all).collect()
    return [(r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in rows]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, least_steps: int = 800, batch: int = 32, rate: float = 4.0, miss: float = 0.001, seed: int = 7) -> Model:
    """Fits embeddings and softmax on four fifths of the rows and calibrates on the others. A small sample
    is gone through more often, for least_steps batches."""
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(lang) for lang, _, _ in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    means = [(b.astype(np.int64), (n / n.sum()).astype(np.float64)) for _, b, n in rows]
    fit = np.flatnonzero(~held)
    epochs = max(epochs, -(-least_steps // -(-len(fit) // batch)))
    steps, done = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.zeros((len(part), BUCKETS))
            for k, i in enumerate(part):
                x[k, means[i][0]] = means[i][1]
            hidden = x @ emb
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            lr = rate * (1 - done / steps) / len(part)
            back = p @ out.T
            out -= lr * hidden.T @ p
            bias -= lr * p.sum(0)
            # the more subwords share a mean, the less each moves it, so the longer the step for each
            emb -= lr * min(len(part), 1 / (x * x).sum(1).mean()) * (x.T @ back)
            done += 1
    model = Model(langs, emb @ out, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else fit
    sums = np.stack([model.scores[means[i][0]].T @ means[i][1] for i in check])
    ones = np.ones(len(check))

    # targets smoothed as by Platt: a sample without errors must not make the model certain
    doubt = 1 / (len(check) + 2)
    target = np.full((len(check), len(langs)), doubt / max(len(langs) - 1, 1))
    target[np.arange(len(check)), y[check]] = 1 - doubt if len(langs) > 1 else 1

    def loss(t: float) -> float:
        model.temperature = t
        return -(target * np.log(np.maximum(model.probabilities(sums, ones), 1e-300))).sum(1).mean()

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
    p = model.probabilities(sums, ones)
    right = p.max(1)[p.argmax(1) == y[check]]
    # a text whose best language is no better than even is doubtful whatever the sample says
    model.threshold = float(min(np.quantile(right, miss), 0.5)) if len(right) else 0.0
    return model


ADDED = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, lang_score (calibrated probability) and lang_rejected, in place of own
    columns named so. A null text, or one without letters, is `und`, scores 0 and is rejected; so is
    every text if the model knows no language. Whole texts are read; equal texts get equal results."""
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = with_fields(docs, "lang_pred string", "lang_score double", "lang_rejected boolean")

    def run(batches):
        # the same model has the same cache in all of a worker's tasks
        words = only_cache(("scores", zlib.crc32(model.scores.tobytes()), *model.langs), lambda: WordScores(model))
        for whole in batches:
            for batch in clipped_batches(whole, 1 << 20):
                texts = batch.column("text").to_pylist()
                sums = words.of([x or "" for x in texts])
                n = sums[:, -1]
                known = (n > 0) & bool(model.langs)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if known.any():
                    p = model.probabilities(sums[known, :-1], n[known])
                    best[known], score[known] = p.argmax(1), p.max(1)
                pred = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(~known | (score < model.threshold))], names=[*kept, *ADDED])

    return small_batches(docs).mapInArrow(tidied(run), schema)


def fit(docs: DataFrame, per_lang: int = PER_LANG, in_all: int = IN_ALL) -> Model:
    """Learns from text and lang of the docs whose fold (of 4, by id) is not 2. Null langs and texts
    teach nothing; empty tables give a model that knows no language."""
    return train(sample(docs.filter(fold("doc_id", 4) != 2), per_lang, in_all))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
