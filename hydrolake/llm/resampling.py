"""Importance resampling towards a target: weights of hashed n-grams, a random key, and a distributed radix sort.

Words and pairs of words are hashed into buckets. Each bucket's share in the target against its share in
all documents gives its gain, an array of fixed size; a document's weight is the mean gain of its
features. With a random number from the id (Gumbel noise) added, the documents with the highest scores
are a draw without replacement in proportion to their weights.

Ranks come from a least-digit-first radix sort over the composite key (score descending, id ascending),
some bits at a time. In a pass, rows stand in blocks of consecutive places; rows of a block are counted
by digit, running sums over digits and blocks give where each block's rows of a digit begin, and a row's
place within them is its destination. No task sees more than a block of one digit, and the order within
equal digits stays, so a pass is stable. Digits that are the same in all rows need no pass.

Cases: a null or empty text has no words, no features and weight 0, and isn't drawn; rows of one id and
score are ranked one after the other in any order; a null id has the noise of an empty id and comes behind the others
of its score; an empty target has no features; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import cut, shared_table

BUCKETS, LEAST_WORDS, DRAWN = 10_000, 20, 25
#: Bits of a digit, and of the places in a block.
DIGIT, BLOCK = 12, 13
#: Bytes of a text read at once.
CHUNK = 1 << 20

_OTHER = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(b for b in _OTHER if not 0x41 <= b <= 0x5A), bytes(range(0x61, 0x7B)) + b" " * (len(_OTHER) - 26))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, some of them at a time."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Hasher:
    """Buckets of the words and pairs of words of texts."""

    def __init__(self, buckets: int, kept: int = 200_000):
        self.buckets, self.kept = buckets, kept
        self.begun: dict[bytes, int] = {}  # of a word and a space, to go on from with the next word

    def of(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """How many words, and the bucket of each feature, of a text's parts of some megabyte."""
        last = None
        for words in words_of(text):
            if not words:
                continue
            if len(self.begun) > self.kept:
                self.begun.clear()
            begun, starts = self.begun, []
            for w in words:
                h = begun.get(w)
                if h is None:
                    h = begun[w] = crc32(w + b" ")
                starts.append(h)
            single = np.fromiter(map(crc32, words), np.int64, len(words))
            pairs = np.fromiter(map(crc32, words if last is not None else words[1:], [last, *starts] if last is not None else starts), np.int64)
            yield len(words), np.concatenate([single, pairs]) % self.buckets
            last = starts[-1]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, part in hasher.of(text.as_py()):
                    counts += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, object)
    for r in summed.collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight."""
    n, s_all, t_all = float(len(source)), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """Each document's features, weight and score: doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(gain))
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = features = total = 0
                for words, part in hasher.of(text.as_py()):
                    n, features, total = n + words, features + len(part), total + int(gain[part].sum())
                weight = total // features if features else 0
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                rows.append((i, n, features, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _ordered(c: Column) -> Column:
    """A long whose bits, read without a sign, are in the order of the numbers."""
    return c.bitwiseXOR(F.lit(-(2**63)))


def radix_places(df: DataFrame, keys: list[Column], digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """Add `place`, from 0, in the order of several long keys (the first counts most; none is null)."""
    names = [f"__key{k}" for k in range(len(keys))]
    # Numbers of a partition's rows begin at a multiple of 2^33, so blocks never span partitions.
    rows = cut(df.withColumns({n: _ordered(k) for n, k in zip(names, keys)}).withColumn("place", F.monotonically_increasing_id()))
    bits = rows.agg(*(f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.bit_and, F.bit_or))).first()
    if bits[0] is None:
        return rows.drop(*names)
    mask = (1 << digit) - 1
    for n in reversed(names):
        varies = (bits[f"bit_and{n}"] ^ bits[f"bit_or{n}"]) & (2**64 - 1)
        for shift in range(0, 64, digit):
            if varies >> shift & mask:
                rows = cut(_pass(rows, F.shiftrightunsigned(n, shift).bitwiseAND(F.lit(mask)), block))
    if not any((bits[f"bit_and{n}"] ^ bits[f"bit_or{n}"]) for n in names):
        rows = _pass(rows, F.lit(0).cast("long"), block)  # all keys are equal: dense places in the order at hand
    return rows.drop(*names)


def _pass(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """One stable counting sort: the new place of each row by its digit."""
    rows = rows.withColumns({"__block": F.shiftright("place", block), "__digit": digit})
    counts = rows.groupBy("__digit", "__block").agg(F.count("*").alias("n"))
    blocks = Window.partitionBy("__digit").orderBy("__block")
    before = counts.withColumn("__before", F.sum("n").over(blocks) - F.col("n"))
    digits = counts.groupBy("__digit").agg(F.sum("n").alias("n"))
    base = digits.select("__digit", (F.sum("n").over(Window.orderBy("__digit")) - F.col("n")).alias("__base"))  # a row a digit
    offsets = before.join(F.broadcast(base), "__digit").select("__digit", "__block", (F.col("__base") + F.col("__before")).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__digit", "__block").orderBy("place")) - 1
    placed = rows.withColumn("__within", within).join(offsets, ["__digit", "__block"])
    return placed.withColumn("place", F.col("__offset") + F.col("__within")).drop("__digit", "__block", "__offset", "__within")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its rank in the draw: doc_id, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = shared_table(scored(docs, gain), "weights")
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    # The largest long stands for no id; a real one would stand beside it.
    placed = radix_places(able, [-F.col("score"), F.coalesce("doc_id", F.lit(2**63 - 1))])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, rank).unionByName(rest)
