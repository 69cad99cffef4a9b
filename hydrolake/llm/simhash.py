"""Document fingerprints by SimHash, and their search by permuted block tables.

A term is a pair of neighbouring words (the word itself in a text of one word). Its hash votes with
weight 1 + ln(frequency) for each set bit and against each clear one; the fingerprint has the bits
with positive votes. Word pairs, not words, keep the common words of a language from deciding.

The search splits the 64 bits into `BLOCKS` blocks. Fingerprints at most `radius` bits apart agree on
at least BLOCKS - radius blocks, so there is a table for each choice of that many blocks, keyed by
their bits: the blocks permuted to the front. A pair is counted in the first table where it meets.

Cases: a null, empty or blank text has the zero fingerprint; equal texts have equal fingerprints;
texts of any length are read whole; equal ids follow one another by their text's hash and null ids
come first; the only document of a table is its own next one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.buckets import cells
from hydrolake.llm.common import cut, map_rows, spread_join

BITS, RADIUS, BLOCKS = 64, 3, 5
#: Terms that vote at once.
PART = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    terms = [a + b" " + b for a, b in zip(words, words[1:])] or words
    counts = Counter(terms)
    hashes = [xxhash.xxh64_intdigest(t) for t in counts]
    weights = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    votes = np.zeros(BITS)
    for at in range(0, len(hashes), PART):
        bits = np.unpackbits(np.array(hashes[at : at + PART], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[at : at + PART] @ bits
    return int(np.packbits(2 * votes > weights.sum(), bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """The share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def spliced(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of `after`."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""

    def make():
        def block(rows):
            return [{"id": r["id"], "fp": int(np.uint64(fingerprint(r["text"])).astype(np.int64))} for r in rows]

        return block

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


EDITED = "part int, place int, doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint, text string"


def _edits(batches):
    """Rows in order to their results; a partition's first row gives its text on, its last waits for the next partition's."""
    part, before, place = TaskContext.get().partitionId(), None, 0

    def row(doc_id, text, fp, after, after_fp):
        edited = spliced(text, after)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, fingerprint(edited), after_fp

    def table(rows):
        names = [x.split(" ")[0] for x in EDITED.split(", ")]
        columns = dict(zip(names, zip(*rows)))
        columns |= {c: np.array([x or 0 for x in columns[c]], np.uint64).view(np.int64) for c in ("fp", "edited_fp", "next_fp")}
        types = {"part": pa.int32(), "place": pa.int32(), "edited_sha256": pa.string(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.int64())) for c in names], names)

    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            out = []
            for r in whole.slice(at, 200).to_pylist():
                now = (r["doc_id"], r["text"] or "", fingerprint(r["text"]))
                if before is None:
                    out.append((part, 0, now[0], None, None, now[2], None, None, now[1]))
                else:
                    out.append((part, 1, *row(*before, *now[1:]), None))
                before = now
            if out:
                yield table(out)
    if before is not None:
        yield table([(part, 2, before[0], None, None, before[2], None, None, before[1])])


def _last(rows: list[dict]) -> list[dict]:
    out = []
    for r in rows:
        edited = spliced(r["text"], r["after"])
        edited_fp = int(np.uint64(fingerprint(edited)).astype(np.int64))
        out.append({"doc_id": r["doc_id"], "n_chars": len(r["text"]), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fp": r["fp"], "edited_fp": edited_fp, "next_fp": r["next_fp"]})
    return out


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each document, its fingerprint, that of its edit with the next document, and the next one's.

    The texts are range-partitioned by id and text hash once, so that a document and the next are
    neighbours. Only each partition's first and last text cross partitions: two rows a partition.
    The driver sees the numbers of the partitions that have rows.
    """
    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    found = cut(ordered.mapInArrow(_edits, EDITED))
    heads = found.filter("place = 0").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fp").alias("next_fp"))
    parts = sorted(r[0] for r in heads.select("next").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    lasts = found.filter("place = 2").select("part", "doc_id", "text", "fp")
    waiting = lasts.join(F.broadcast(following), "part").join(heads, "next").select("doc_id", "text", "fp", "after", "next_fp")
    done = found.filter("place = 1").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
    return done.unionByName(map_rows(waiting, lambda: _last, done.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")))


def blocks() -> list[tuple[int, int]]:
    """The blocks as (first bit, bits), together all 64."""
    edges = [round(BITS * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def tables(radius: int = RADIUS) -> list[tuple[int, ...]]:
    """The blocks that each table has in front."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the tables hold for radius 0 to {BLOCKS - 1}")
    return list(combinations(range(BLOCKS), BLOCKS - radius))


def _index(known: DataFrame, radius: int) -> DataFrame:
    """`known` with a row for each table: its number `t` and the `key` of its front blocks."""
    parts = blocks()

    def entry(t: int, chosen: tuple[int, ...]) -> Column:
        front = [F.shiftrightunsigned("fp", parts[k][0]).bitwiseAND(F.lit((1 << parts[k][1]) - 1)) for k in chosen]
        return F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *front).alias("key"))

    entries = F.explode(F.array(*[entry(t, c) for t, c in enumerate(tables(radius))]))
    return known.select(entries.alias("e"), *known.columns).select("e.key", "e.t", *known.columns)


def near_counts(fps: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """(fp, n_near): for each fingerprint of a row whose id is divisible by `every`, the other rows within `radius` bits.

    Equal fingerprints are one entry with their number. The members of a bucket are compared in
    cells of bounded size that return a count for each asking fingerprint and no pairs.
    """
    known = cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asks")))
    parts = blocks()
    masks = np.array([sum(((1 << parts[k][1]) - 1) << parts[k][0] for k in c) for c in tables(radius)], np.uint64)

    def count(f, n, asks, side, table, out):
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for ask, against in ((left, right), (right, left)) if len(right) else ((left, left),):
            ask = ask[asks[ask]]
            for at in range(0, len(ask), 256):
                some = ask[at : at + 256]
                differ = f[some][:, None] ^ f[against][None, :]
                x, y = np.nonzero((np.bitwise_count(differ) <= radius) & (differ != 0))
                # A pair meets in several tables and is counted in the first of them.
                here = np.argmax((differ[x, y][:, None] & masks[None, :]) == 0, axis=1) == table
                found = np.bincount(x[here], n[against[y[here]]], len(some))
                out += [(k, int(c)) for k, c in zip(f[some].view(np.int64).tolist(), found) if c]

    def run(batches):
        for batch in batches:
            lists, out = batch.column(0), []
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "n", "asks", "side", "t")]
            columns[0] = columns[0].view(np.uint64)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                f, n, asks, side, t = (c[a:b] for c in columns)
                if asks.any():
                    count(f, n, asks, side, t[0], out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["fp", "n"])

    near = cells(_index(known, radius), useful=F.col("asks")).select("members").mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("near"))
    return known.filter("asks").join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"))


def report(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """The query's columns, and `n_near` for the asking rows (null for the others)."""
    pairs = edited_pairs(docs)
    near = near_counts(pairs.select("doc_id", "fp"), radius, every)
    alike = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counted = spread_join(pairs.filter(asks), near, "fp", "doc_id", "left")
    rows = counted.unionByName(pairs.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"), alike("fp", "edited_fp").alias("near_edited"), alike("fp", "next_fp").alias("near_next"), "n_near")
