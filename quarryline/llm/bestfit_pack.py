"""Best-fit packing of documents into token sequences, planned over the histogram of lengths.

Documents become pieces of at most `capacity` tokens. Best-fit decreasing runs on the counts of pieces
per length, not on pieces: a step puts q pieces of one length into q sequences with the same room, so
the plan is a short table of (length, ranks, first sequence, offset). A piece takes the slot that the
plan has for its rank among the pieces of its length. Ranks come from windows over (length, bucket)
and prefix sums of the buckets' counts, so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Remembered, clipped_batches, only_cache, row_key, scratched, small_batches, stage, table, tidied, with_fields

CAPACITY = 2048
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 300_000


def byte_characters() -> dict[int, int]:
    """How byte-level tokenizers write a byte: visible Latin-1 characters stand for themselves, the
    others, in order, for the code points from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(rest)}


def plain_letters(word: str) -> str:
    """A word in lower case, if it has letters only, also then, and is composed; else nothing. A final
    sigma depends on its place, so words with a capital one are left out."""
    if not word.isalpha() or "Σ" in word or not unicodedata.is_normalized("NFC", word):
        return ""
    low = word.lower()
    return low if low.isalpha() else ""


@cache
def pack_ids(n: int):
    return struct.Struct(f"<{n}I").pack


class WordIds(Remembered):
    """Little-endian uint32 ids of white-space-free words, as bytes.

    The tokenizer drops white space and its pieces never reach over it, so a text's ids are those of
    its words, one after another. New words are encoded together, parted by a mark that is a piece of
    its own. Where the tokenizer lower-cases and parts final punctuation from letters, words are
    remembered without case and without it.
    """

    MARK = "\x01"
    #: What ends words: ASCII punctuation but for the apostrophe, which begins pieces of its own.
    TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(REMEMBERED)
        tokenizer = Tokenizer.from_file(path)
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        mark = self.encode(self.MARK)
        self.mark = mark[0] if len(mark) == 1 and self.encode(f"a {self.MARK} b") == self.encode("a") + mark + self.encode("b") else None
        self.lowers = self.encode("QUITE So") == self.encode("quite so")
        # a word of letters is one piece, which goes to the model as it is, its bytes written as
        # characters, where that gives the same ids
        model, self.written = tokenizer.model, byte_characters()
        self.direct = lambda word: [t.id for t in model.tokenize(word)]
        tried = ("a", "word", "quite", "thorreou", "zqxj", "antidisestablishment", "été", "straße", "ñandú", "слово", "日本")
        self.letters = self.lowers and all(self.direct(w.encode().decode("latin-1").translate(self.written)) == self.encode(w) for w in tried)
        self.parts = all(self.encode("wordé" + e) == self.encode("wordé") + self.encode(e) for e in (*self.TAIL.decode(), "...", "$$$", "?!", "***", ").", "--", "_-"))
        self.tails: dict[bytes, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def head(self, word: bytes) -> bytes:
        """A word without its final punctuation, if what is left ends with a letter; else the word."""
        out = word.rstrip(self.TAIL)
        if len(out) == len(word) or not out or not self.parts or b"<|" in word:
            return word
        # some letters end with a mark in lower case
        return out if out[-1:].isalpha() or out[-1] > 127 and (last := out.decode("utf-8", "replace")[-1]).isalpha() and last.lower().isalpha() else word

    def learn(self, words: set[bytes]) -> None:
        new = self.unknown(words)
        ended = [(w, h) for w in new if (h := self.head(w)) is not w]
        plain = set(new).difference(w for w, _ in ended)
        plain.update(h for _, h in ended)
        mark, odd = self.MARK.encode(), []
        for w in plain:
            if w in self:
                continue
            if self.letters and w.isalpha() and w.islower():  # of bytes: ASCII letters
                ids = self.direct(w.decode())
            elif self.letters and (low := plain_letters(w.decode("utf-8", "replace"))):
                ids = self.direct(low.encode().decode("latin-1").translate(self.written))
            elif self.mark is None or mark in w:
                self[w] = self.raw(w.decode("utf-8", "replace"))
                continue
            else:
                odd.append(w)
                continue
            self[w] = pack_ids(len(ids))(*ids)
        for at in range(0, len(odd), 8192):
            part = odd[at : at + 8192]
            ids = np.array(self.encode(f" {self.MARK} ".join([w.decode("utf-8", "replace") for w in part])), "<u4")
            edges = np.flatnonzero(ids == self.mark)
            raw, starts, stops = ids.tobytes(), [0, *(4 * edges + 4).tolist()], [*(4 * edges).tolist(), 4 * len(ids)]
            self.update(zip(part, [raw[a:b] for a, b in zip(starts, stops)]))
        for w, h in ended:
            tail = w[len(h) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self.raw(tail.decode())
            self[w] = self[h] + self.tails[tail]

    def texts(self, texts: list[bytes | None]):
        """The ids of each text, as bytes."""
        # a special token's sign is told by case, so such texts keep theirs
        split = [((x or b"").lower() if self.lowers and b"<|" not in (x or b"") else (x or b"")).split() for x in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """The process's WordIds of a tokenizer file."""
    return only_cache(("ids", path), lambda: WordIds(path))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut every `capacity` ids.

    tokenizer: path of a file of `tokenizers` that drops white space. A null or empty text is end_id
    alone. crc32 is over little-endian unsigned 32-bit ids. Only doc_id and text are read.
    """

    def run(batches):
        ids_of = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in clipped_batches(whole, 1 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.texts(batch.column("text").cast(pa.binary()).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset), by length and rank, for `counts` pieces of
    each length. Best fit, longest first: a piece goes where the least room is left that holds it."""
    room: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, sequences)
    rooms: list[int] = []
    out, sequences = [], 0

    def free(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece has {length} tokens")
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = capacity, sequences, -(-todo // (capacity // length))
                sequences += n
            per = left // length
            full = min(n, todo // per)
            if full:
                for k in range(per):
                    out.append((length, rank, full, first, capacity - left + k * length))
                    rank += full
                todo -= full * per
                free(left - per * length, first, full)
            if full < n and todo:  # the last sequence takes what is left over, fewer than per
                for k in range(todo):
                    out.append((length, rank, 1, first + full, capacity - left + k * length))
                    rank += 1
                free(left - todo * length, first + full, 1)
                todo, full = 0, full + 1
            free(left, first + full, n - full)
    return out


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """pieces plus rank, from 0 within each length, by bucket, id and piece."""
    buckets = max(64, -(-rows // 50_000))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64(row_key(), "piece"), F.lit(buckets)).cast("int"))
    sums = pieces.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    return pieces.withColumn("_k", F.row_number().over(order) - 1).join(sums, ["length", "_b"]).withColumn("rank", F.col("_at") + F.col("_k")).drop("_b", "_k", "_at")


@scratched
def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """cut_pieces plus sequence_id and offset: sequences hold at most `capacity` tokens without gaps.

    Ties take slots in the order of hash bucket, id, piece and crc32; repeated rows are packed each;
    no documents, no sequences. The driver sees one count per length, `capacity` at most.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = sorted(plan(counts, capacity))
    # the plan's size follows the number of lengths, not of documents
    slots = spark.sparkContext.broadcast(np.array(steps, np.int64).reshape(-1, 5))
    schema = with_fields(pieces, "sequence_id long", "offset long")

    def run(batches):
        length, first, _, sequence, offset = slots.value.T
        starts = length << 44 | first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, own << 44 | rank, "right") - 1
            cols = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=schema.names)

    return stage(ranked(pieces, sum(counts.values())).mapInArrow(tidied(run), schema), "packed", keep=True)


def op2_bestfit_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
