"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most 4 bits apart differ in at most 4 of their 8 bytes, so they
share the bytes at 4 positions or more: that is the guaranteed minimum of the count filter.
Posting lists of single positional bytes would hold 1/256 of the corpus each, so the index is
keyed by four positional bytes together, one list for each of the 70 choices of positions: every
pair that passes the count filter meets in a bucket. Within a bucket the shared positional bytes of
each pair are tallied, pairs below the minimum are left, and the rest are verified by their bits.

Equal fingerprints are one entry of the index, so exact copies cost nothing there. Buckets are
compared in cells of bounded size and each cell returns only a spanning forest of its links,
which keeps the components and leaves no quadratic number of rows behind a group of near copies.

The pipeline's stage (`keep_one`) has a contract of its own: shingles of five words and a Jaccard
likeness of 0.8. Of such pairs some 15 of 100 bits differ, beyond what lists of 64 bits can hold, so
its fingerprints have 1024 bits, that is 256 positions of half a byte, and 192 lists, each keyed by
four positions. An entry carries its first 32 positions: pairs of a list that share fewer than
`STAGE_SHARED` of them are left, the rest are verified by their bits. What is so linked forms groups,
and within a group the exact likeness of whole sets decides.

Cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated
rows and equal doc_ids are rows of their own with equal results; null doc_ids are kept, and a
component of them alone has a null id, and ids may be any longs; other columns are ignored by `near_groups` and kept by
`keep_one`; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.buckets import cells
from hydrolake.llm.common import cut, map_rows, spread_join, tidy
from hydrolake.llm.components import connected_components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
WORDS, SEED, RADIUS = 4, 42, 4
#: Byte positions that key the index together.
POSITIONS = tuple(combinations(range(8), 4))
#: The pipeline's stage: words of a shingle and least Jaccard likeness (numerator, denominator) of linked texts.
STAGE_WORDS, LIKE = 5, (4, 5)
#: Bits of the stage's fingerprints, and the lists of each: every four half-byte positions once, then in two more orders.
STAGE_BITS = 1024
ORDERS = [np.random.default_rng([SEED, k]).permutation(STAGE_BITS // 4) if k else np.arange(STAGE_BITS // 4) for k in range(3)]
LISTS = np.concatenate(ORDERS).reshape(-1, 4)
#: Of the 32 half bytes that an entry carries, those that a pair shares at least, and the bits of 128 that differ at most.
STAGE_SHARED, STAGE_RADIUS = 5, 38
#: Entries of a list that are compared in one cell, and one in how many is counted to find longer lists.
ENTRIES, COUNTED = 2048, 16
#: Entries that one job deals to its tasks; of more fingerprints a job takes fewer lists, so the disk for entries stays the same.
JOB = 100_000_000
#: Sorted entries that a task compares at once.
ROWS = 1 << 17
#: Sets and hashes of a chunk of a group, and hashes that a cell compares at once.
CHUNK, CHUNK_HASHES, COLUMNS = 256, 1 << 19, 4096
#: Hashes that are counted at once; a long text is counted in several parts.
PART = 1 << 16


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """The word shingles of a text, A-Z lower-cased, repeats included; fewer words are one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[: len(tokens) - words] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str | None) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes; no words: zero."""
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles(text)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        bits = np.array(hashes[at : at + PART], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and `fp` (the fingerprint's 64 bits as a signed long)."""
    fields = [docs.schema[c] for c in keep]

    def make():
        def block(rows):
            for r in rows:
                r["fp"] = int(np.uint64(fingerprint(r.pop("__text"))).astype(np.int64))
            return rows

        return block

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp bigint"])
    return map_rows(docs.select(*keep, F.col(text_col).alias("__text")), make, schema)


def index_rows(fps: DataFrame) -> DataFrame:
    """(key, fp, id) for each choice of positions: the key is the choice's number and its four bytes."""
    # Choices are a constant array of shifts, so the code of a key is made once and not seventy times.
    choices = F.array(*[F.array(*[F.lit(8 * p) for p in c]) for c in POSITIONS])
    each = fps.select(F.posexplode(choices).alias("n", "at"), "fp", "id")
    octet = lambda k: F.call_function("shiftrightunsigned", F.col("fp"), F.col("at")[k]).bitwiseAND(F.lit(255))
    key = F.col("n").cast("long") * (1 << 32) + octet(0) * (1 << 24) + octet(1) * 65536 + octet(2) * 256 + octet(3)
    return each.select(key.alias("key"), "fp", "id")


def _forest(fp: np.ndarray, side: np.ndarray, ids: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a cell, as (member, smallest linked id): a spanning forest of its verified pairs."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    parent = list(range(len(fp)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    octets = fp.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        shared = (octets[some][:, None, :] == octets[right][None, :, :]).sum(2, dtype=np.int8)
        a, b = np.nonzero(shared >= 8 - radius)
        a, b = some[a], right[b]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (a != b)
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y, key=ids.__getitem__)] = min(x, y, key=ids.__getitem__)
    return [(ids[x], ids[root(x)]) for x in range(len(fp)) if parent[x] != x]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp, id) to edges (u, v) between ids whose transitive closure is that of all links."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            lists = batch.column(0)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fp, ids, side = flat.field("fp").to_numpy().view(np.uint64), flat.field("id").to_numpy(), flat.field("side").to_numpy()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a == 2:
                    if int(fp[a] ^ fp[a + 1]).bit_count() <= radius:
                        u.append(int(ids[a]))
                        v.append(int(ids[a + 1]))
                    continue
                for x, y in _forest(fp[a:b], side[a:b], ids[a:b].tolist(), radius):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return cells(index_rows(fps)).select("members").mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): fingerprints linked at `radius` bits or fewer, transitively.

    component_id is the smallest id reachable over links, the row's own included.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the index of four positional bytes holds for radius 0 to 4")
    rows = cut(fingerprints(docs, [id_col], text_col))
    # Components are found among fingerprints, so ids may be any longs or null.
    known = cut(rows.groupBy("fp").agg(F.min(id_col).alias("id")))
    parts = connected_components(links(known.select("fp", F.col("fp").alias("id")), radius))
    linked = cut(known.join(parts, known["fp"] == parts["node"]).select("fp", "id", "component"))
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    named = spread_join(linked, least, "component", "fp").select("fp", "component_id")
    alone = known.join(linked, "fp", "left_anti").select("fp", F.col("id").alias("component_id"))
    return spread_join(rows, named.unionByName(alone), "fp", id_col, "left").select(id_col, "fp", "component_id")


def _sketch_set(text: str | None) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, STAGE_WORDS)], "<u8"))


@cache
def _weights() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, np.iinfo(np.uint64).max, (2, 4096, STAGE_BITS // 8), np.uint64, endpoint=True)


def _wide(found: np.ndarray) -> np.ndarray:
    """The `STAGE_BITS` bits of a set of hashes, as bytes: bit k is set if the hashes' signed bytes k sum up to more than zero.

    A hash's bytes are those of two rows of a table. Whole bytes and not mere signs, so that small sets have no ties.
    """
    low, high = _weights()
    total = np.zeros(STAGE_BITS, np.int64)
    for at in range(0, len(found), 512):
        h = found[at : at + 512]
        total += (low[(h & np.uint64(4095)).astype(np.intp)] ^ high[(h >> np.uint64(12) & np.uint64(4095)).astype(np.intp)]).view(np.int8).sum(0, dtype=np.int32)
    return np.packbits(2 * total + len(found) > 0, bitorder="little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, key, n, node, fp): a hash of the text, one of its set of shingles, the set's size, its fingerprint's first 64 bits and all of them."""

    def make():
        def block(rows):
            for r in rows:
                found = _sketch_set(r.pop("__text"))
                r["key"], r["n"], r["fp"] = _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)), len(found), _wide(found).tobytes()
                r["node"] = int.from_bytes(r["fp"][:8], "little", signed=True)
            return rows

        return block

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("__text"))
    return map_rows(own, make, f"id {kind}, tk bigint, key bigint, n int, node bigint, fp binary")


def _entries(fps: DataFrame, begin: int = 0, end: int = len(LISTS)) -> DataFrame:
    """(list, f0, f1, key) of (fp, key): an entry in each of the lists from `begin` to before `end`. A list's number is that of its positions and their half bytes; f0 and f1 are the first 128 bits."""

    def run(batches):
        own_lists, number = LISTS[begin:end], np.arange(begin, end, dtype=np.int64) << 16
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                octets = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                halves = np.stack([octets & 15, octets >> 4], -1).reshape(part.num_rows, -1).astype(np.int64)
                lists = number + sum(halves[:, own_lists[:, k]] << 4 * k for k in range(4))
                first = np.ascontiguousarray(octets[:, :16]).view("<i8")
                own = [first[:, 0], first[:, 1], part.column(1).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel()), *(pa.array(np.repeat(x, len(own_lists))) for x in own)], ["list", "f0", "f1", "key"])

    return fps.select("fp", "key").mapInArrow(run, "list long, f0 long, f1 long, key long")


def _long_lists(fps: DataFrame, most: int) -> DataFrame:
    """(list, chunks) of the lists that have more than some `most` entries.

    One of `COUNTED` fingerprints is counted. That only says how lists are dealt: all entries are compared either way.
    """
    some = _entries(fps.filter(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(COUNTED)) == 0))
    return cut(some.groupBy("list").count().filter(F.col("count") * COUNTED > most).select("list", F.ceil(F.col("count") * COUNTED / most).cast("int").alias("chunks")))


def _placed_entries(entries: DataFrame, long: DataFrame | None) -> DataFrame:
    """(cell, side, f0, f1): the entries of each list, in cells of two chunks where a list is one of the `long` ones."""
    chunk = lambda x: F.pmod(F.xxhash64(F.lit(5), "key"), F.col(x)).cast("int")
    whole = lambda df: df.select(F.col("list").alias("cell"), F.lit(0).alias("side"), "f0", "f1")
    if long is None:
        return whole(entries)
    dealt = entries.join(F.broadcast(long), "list").withColumn("c", chunk("chunks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = (f("c", "other").cast("long") for f in (F.least, F.greatest))
    # The number of a list has 24 bits. Cells that compare a chunk with itself have one side.
    cell = F.col("list") + i * (1 << 24) + j * (1 << 43)
    return whole(entries.join(F.broadcast(long), "list", "left_anti")).unionByName(dealt.select(cell.alias("cell"), (F.col("c") > F.col("other")).cast("int").alias("side"), "f0", "f1"))


def _close(cell: np.ndarray, side: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest linked) of sorted cells, over the pairs within a cell that pass the tally of half bytes and then the bits.

    Links are stars, so that lists with the same members return the same rows.
    """
    f0, f1 = f0.view(np.uint64), f1.view(np.uint64)
    ones = np.uint64(0x1111111111111111)
    # A cell of two chunks compares one with the other only.
    two = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
    two = np.repeat(np.maximum.reduceat(side, two), np.diff(two, append=len(cell))) if len(cell) else side
    label = np.arange(len(cell))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = int(label[x])
        return x

    a, d = np.arange(len(cell)), 0
    while len(a):
        d += 1
        a = a[: np.searchsorted(a, len(cell) - d)]
        a = a[cell[a] == cell[a + d]]
        own = a[(label[a] != label[a + d]) & ((two[a] == 0) | (side[a] != side[a + d]))]
        x0, x1 = f0[own] ^ f0[own + d], f1[own] ^ f1[own + d]
        half = [x | x >> np.uint64(1) for x in (x0, x1)]
        shared = 32 - sum(np.bitwise_count((h | h >> np.uint64(2)) & ones) for h in half) >= STAGE_SHARED
        own, x0, x1 = own[shared], x0[shared], x1[shared]
        own = own[np.bitwise_count(x0) + np.bitwise_count(x1) <= STAGE_RADIUS]
        for x in own.tolist():
            u, v = root(x), root(x + d)
            if u != v:
                label[max(u, v)] = min(u, v)
        if len(own):
            while (label != (up := label[label])).any():
                label = up
    least = f0.view(np.int64).copy()
    np.minimum.at(least, label, f0.view(np.int64))
    linked = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    return f0.view(np.int64)[linked], least[label[linked]]


def stage_links(fps: DataFrame, most: int | None = None) -> DataFrame:
    """(fp, key) to edges (u, v) between the first 64 bits of fingerprints, whose closure is that of all pairs that the lists link."""
    n = fps.count()
    long = _long_lists(fps, most or max(ENTRIES, 8 * n >> 16))
    long = None if long.isEmpty() else long
    step = max(1, min(len(LISTS), JOB // max(n, 1)))

    def run(batches):
        held, rows = [], 0

        def links(last: bool):
            nonlocal held, rows
            cell, side, f0, f1 = (np.concatenate([h[k] for h in held]) for k in range(4))
            # The last cell may go on in the next batch.
            end = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            held, rows = [(cell[end:], side[end:], f0[end:], f1[end:])], 0
            u, v = _close(cell[:end], side[:end], f0[:end], f1[:end])
            apart = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(4)))
            rows += batch.num_rows
            if rows >= ROWS:
                yield links(False)
        if held:
            yield links(True)

    def linked(begin: int) -> DataFrame:
        placed = _placed_entries(_entries(fps, begin, min(begin + step, len(LISTS))), long)
        return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")

    jobs = [linked(begin) for begin in range(0, len(LISTS), step)]
    found = jobs[0] if len(jobs) == 1 else reduce(DataFrame.unionByName, [cut(x.distinct()) for x in jobs])
    # Lists name different members as a group's smallest: a member keeps the least of them, and these are linked among each other.
    least = found.groupBy("u").agg(F.collect_set("v").alias("all")).withColumn("m", F.array_min("all"))
    star = F.transform("all", lambda v: F.struct(F.when(v == F.col("m"), F.col("u")).otherwise(v).alias("u"), F.col("m").alias("v")))
    return least.select(F.explode(star).alias("e")).select("e.u", "e.v")


def _sets(texts: DataFrame) -> DataFrame:
    """(key, s): the hashes of the shingles of each row of texts (key, text)."""

    def make():
        def block(rows):
            return [{"key": r["key"], "s": _sketch_set(r["text"]).view("<i8").tolist()} for r in rows]

        return block

    return map_rows(texts, make, "key bigint, s array<bigint>")


def _enough(common, nu, nv):
    """Whether a Jaccard likeness is `LIKE` or more, of numbers, arrays or columns."""
    return LIKE[1] * common >= LIKE[0] * (nu + nv - common)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v, nu, nv) of sets whose exact Jaccard likeness is `LIKE` or more; `sets`: (key, s)."""
    both = pairs.join(sets.withColumnRenamed("s", "sv"), pairs["v"] == sets["key"]).drop("key").join(sets.withColumnRenamed("s", "su"), F.col("u") == F.col("key"))
    return both.filter(_enough(F.size(F.array_intersect("su", "sv")), F.col("nu"), F.col("nv"))).select("u", "v")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of hashes that each set of `left` shares with each of `right`."""
    own = [*left, *right]
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, columns, seen = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    rows, columns = rows[shared := seen[columns] > 1], columns[shared]
    _, columns = np.unique(columns, return_inverse=True)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [at, at + COLUMNS])
        has = np.zeros((len(own), COLUMNS), np.float32)
        has[rows[a:b], columns[a:b] - at] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _linked(side: list[int], keys: list[int], parts: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (of parts) of a cell that bring together what is not so yet: a star for each group of parts with alike sets."""
    up = {p: p for p in parts}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left = [k for k, x in enumerate(side) if x == 0]
    right = [k for k, x in enumerate(side) if x == 1] or left
    size = np.array([len(x) for x in sets])
    common = _common([sets[k] for k in left], [sets[k] for k in right])
    near = _enough(common.astype(np.int64), size[left][:, None], size[right][None, :])
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        x, y = left[i], right[j]
        a, b = root(parts[x]), root(parts[y])
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(p, root(p)) for p in up if root(p) != p]


def _between(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the parts of alike members (band, key, n, part) of one band, a group of the index, that are in different parts.

    A band's members are dealt to chunks of at most `CHUNK` sets and some `CHUNK_HASHES` hashes, and each pair of
    chunks is a cell that a task compares: no pair is a row, and a cell returns only links that bring parts together.
    """
    mixed = placed.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("total") / CHUNK_HASHES)).cast("int")
    dealt = spread_join(placed, mixed.select("band", chunks.alias("chunks")), "band", "key", merge=True).withColumn("c", F.pmod(F.xxhash64(F.lit(7), "key"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells_ = dealt.select("band", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), (F.col("c") > F.col("other")).cast("int").alias("side"), "key", "part")
    gathered = cells_.join(sets, "key").groupBy("band", "i", "j").agg(F.collect_list(F.struct("side", "key", "part", "s")).alias("members")).select("members")

    def run(batches):
        for batch in batches:
            u, v = [], []
            for members in batch.column(0):
                own = members.values
                side, keys, parts = (own.field(c).to_pylist() for c in ("side", "key", "part"))
                held = own.field("s")
                flat, offsets = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
                for x, y in _linked(side, keys, parts, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return gathered.mapInArrow(run, "u long, v long")


def _resolved(texts: DataFrame) -> DataFrame:
    """(key, part) of texts (band, key, text) in bands of `CHUNK` texts and `CHUNK_HASHES` hashes at most: texts of one part are alike, directly or over others.

    A task has a band as a whole, so its sets are made and compared there and none is written.
    """
    placed = texts.select("band", "key", "text").repartition("band").sortWithinPartitions("band")

    def parts(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        least = min(held)
        first = held[least]
        near = {k: least if k == least or _enough(len(np.intersect1d(first, x, assume_unique=True)), len(first), len(x)) else k for k, x in held.items()}
        if len(set(near.values())) > 1:
            keys = list(held)
            over = dict(_linked([0] * len(keys), keys, [near[k] for k in keys], [held[k] for k in keys]))
            near = {k: over.get(p, p) for k, p in near.items()}
        return list(near.items())

    def run(batches):
        band, held = None, {}
        for batch in batches:
            out = []
            for b, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != band:
                    out += parts(held) if held else []
                    band, held = b, {}
                if key not in held:  # rows may repeat an id and its text
                    held[key] = _sketch_set(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["key", "part"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*parts(held))], ["key", "part"])

    return placed.mapInArrow(run, "key long, part long")


def _wide_parts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, part) of the members (band, key, n, c) of bands of any size: each against the smallest of its band, and in bands that fall apart among each other in cells."""
    sets = cut(_sets(texts.groupBy("key").agg(F.first("text").alias("text"))))
    sized = LIKE[1] * F.least("nu", "nv") >= LIKE[0] * F.greatest("nu", "nv")
    stars = members.select(F.col("c.key").alias("u"), F.col("key").alias("v"), F.col("c.n").alias("nu"), F.col("n").alias("nv")).filter("u <> v").filter(sized)
    # A set is in one group only, so those that are like the group's smallest are a part as they are.
    placed = members.join(_alike(stars, sets).toDF("part", "key"), "key", "left")
    placed = cut(placed.select("band", "key", "n", F.coalesce("part", "key").alias("part")))
    return placed.select("key", F.col("part").alias("node")).join(connected_components(_between(placed, sets)), "node", "left").select("key", F.coalesce("component", "node").alias("part"))


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, part) for each row: its id, the hash of its text, and its component of like texts."""
    tidy(docs.sparkSession)
    rows = cut(sketches(docs, id_col, text_col))
    # Of all copies of a text one row, named by its hash and that of its id, stands for them.
    one = F.min(F.struct("tk", F.xxhash64("id").alias("ik"))).alias("one")
    known = cut(rows.filter("n > 0").groupBy("key").agg(one, *(F.any_value(c).alias(c) for c in ("n", "node", "fp"))))
    grouped = spread_join(known, connected_components(stage_links(known)).withColumnRenamed("component", "band"), "node", "key", "left", merge=True)
    grouped = grouped.select("key", "one", "n", F.coalesce("band", "node").alias("band"))
    large = (F.count("*") > CHUNK) | (F.sum("n") > CHUNK_HASHES)
    shared = grouped.groupBy("band").agg(F.count("*").alias("m"), large.alias("large"), F.min(F.struct("key", "n")).alias("c")).filter("m > 1").drop("m")
    members = cut(spread_join(grouped, shared, "band", "key", merge=True))

    def texts(of: DataFrame) -> DataFrame:
        own = docs.select(F.xxhash64(text_col).alias("tk"), F.xxhash64(id_col).alias("ik"), F.col(text_col).alias("text"))
        return own.join(of.select("band", "key", "one.tk", "one.ik"), ["tk", "ik"])

    parts = cut(_resolved(texts(members.filter("NOT large"))))
    wide = members.filter("large")
    if not wide.isEmpty():
        parts = parts.unionByName(_wide_parts(wide, texts(wide)))
    named = spread_join(rows.select("id", "tk", "key"), parts, "key", "id", "left", merge=True)
    return named.select("id", "tk", F.coalesce("part", "key").alias("part"))


def like_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): texts whose sets of shingles of five words have a Jaccard likeness of 0.8 or more, linked transitively.

    Texts whose fingerprints the index links, directly or over others, are a group, and are verified by their whole
    sets: first each member of a group against the group's smallest, then, in groups whose members are still in
    different parts, those members among each other in cells.
    """
    named = _parts(docs, id_col, text_col)
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    return spread_join(named.drop("tk"), least, "part", "id", merge=True).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each of the `like_groups`: that with the smallest id (and hash of its text).

    Rows are dropped, not ids: rows of one id with unlike texts all stay. Of rows that repeat id and text one stays,
    whichever has the other columns. Rows without an id are kept. Columns of any type and name pass.
    """
    named = _parts(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    kept = named.groupBy("part").agg(F.min(F.struct("id", "tk")).alias("kept"))
    mine = spread_join(named, kept, "part", "id", merge=True)
    # Written down, as it is read twice: for what is left, and for what is left of equal rows.
    other = cut(mine.filter((F.col("kept.id") != F.col("id")) | (F.col("kept.tk") != F.col("tk"))).select("id", "tk").distinct())
    own, tk = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "tk"))  # names that no column has
    rows = docs.withColumns({own: F.col(id_col), tk: F.xxhash64(text_col)})
    left = rows.join(other.toDF(own, tk), [own, tk], "left_anti")
    again = left.filter(F.col(own).isNotNull()).groupBy(own, tk).count().filter("count > 1").select(own, tk)
    if again.isEmpty():
        return left.select(*docs.columns)
    single = left.join(again, [own, tk], "left_anti")
    return single.select(*docs.columns).unionByName(left.join(again, [own, tk], "left_semi").dropDuplicates([own, tk]).select(*docs.columns))


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
