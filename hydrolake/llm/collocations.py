"""Phrase collocations: exact counts of phrases in burst tries, and the phrases that hold together.

Words are counted first. Then each task keeps a trie over its own word numbers for each language: a node
holds its entries in one hash container until that is full; words that head many of them then get a
subtree of their own. A task that holds `ENTRIES` entries spills its largest subtrees whole, as runs
sorted by phrase and cut by prefix partition. Runs of one partition are merged in phrase order, a block
at a time.

The prefix of a phrase ends with its first word that isn't frequent. Frequent words have more than one
of `HEAVY` of all occurrences, so there are `HEAVY` of them at most, and no prefix that can be continued
has more than that share of the phrases.

A phrase of two or three words that occurs `LEAST` times is a candidate. Each cut into two parts has the
score floor(1000000 a a / (l r)); the lowest cut counts. A candidate inside a longer one that has half of
its occurrences is dropped. All counts are exact, and so is the arithmetic (decimals of 38 digits).

Cases: a null or empty text has no words; a null language is `und`; a text of any length is read whole,
by the megabyte; repeated rows count as often as they stand there; ties are broken by phrase; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import shared_table, spread_join

LEAST, TOP, COVER = 10, 2000, 50
#: Frequent words at most; entries of a task's tries; entries of a container before it bursts; bytes of a text and words that are read at once.
HEAVY, ENTRIES, BURST, CHUNK, RUN = 65_536, 1_500_000, 16_384, 1 << 20, 400_000
#: Prefix partitions at least, and phrases that one of them has about at most.
PARTS, PART_PHRASES = 1024, 4_000_000
#: Bits of a word's number in a packed phrase; with more words a task spills all and begins anew.
BITS = 21
WORDS = 1 << 20
UNKNOWN = "und"

MARKS = ".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + MARKS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"." * len(MARKS))
_LOW = (1 << BITS) - 1


def words_of(text: str | None, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in order, some of them at a time, with `.` for every mark that ends a piece."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + chunk) if at + chunk < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in each language: lang, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                found.pop(b".", None)
                names = pa.array(list(found), pa.binary()).cast(pa.string())
                counts = pa.array(list(found.values()), pa.int64())
                for a in range(0, len(names), 50_000):
                    part = names.slice(a, 50_000)
                    yield pa.record_batch([pa.array([lang] * len(part)), part, counts.slice(a, 50_000)], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = held.setdefault(lang.as_py(), {})
                for words in words_of(text.as_py()):
                    before = len(found)
                    for w in words:
                        found[w] = found.get(w, 0) + 1
                    size += len(found) - before
                    if size > ENTRIES:
                        yield from out()
                        found, size = held.setdefault(lang.as_py(), {}), 0
        yield from out()

    counted = _texts(docs).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


class Node:
    """A trie node: subtrees of the words that head many entries, and one hash container for the others."""

    __slots__ = ("shift", "rest", "children", "limit")

    def __init__(self, shift: int):
        self.shift, self.rest, self.children, self.limit = shift, {}, {}, BURST

    def __len__(self) -> int:
        return len(self.rest) + sum(map(len, self.children.values()))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> int:
        """Add sorted packed phrases; how many of them are new."""
        new = 0
        if self.children and len(keys):
            heads = keys >> self.shift
            starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            owned = np.isin(heads[starts], np.fromiter(self.children, np.int64, len(self.children)))
            low = (1 << self.shift) - 1
            for a, b in zip(starts[owned].tolist(), ends[owned].tolist()):
                new += self.children[int(heads[a])].add(keys[a:b] & low, counts[a:b])
            other = np.repeat(~owned, ends - starts)
            keys, counts = keys[other], counts[other]
        rest = self.rest
        before, get = len(rest), rest.get
        for k, n in zip(keys.tolist(), counts.tolist()):
            rest[k] = get(k, 0) + n
        new += len(rest) - before
        if len(rest) > self.limit and self.shift:
            self._burst()
        return new

    def _burst(self) -> None:
        """Give words with many entries in the container subtrees of their own; one that stays full gets twice the room."""
        keys, counts = self._container()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        heads, starts, sizes = np.unique(keys >> self.shift, return_index=True, return_counts=True)
        large = sizes >= max(64, BURST >> 6)
        self.rest = {}
        low = (1 << self.shift) - 1
        for h, a, size in zip(heads[large].tolist(), starts[large].tolist(), sizes[large].tolist()):
            self.children[h] = child = Node(self.shift - BITS)
            child.add(keys[a : a + size] & low, counts[a : a + size])
        stay = np.repeat(~large, sizes)
        self.rest.update(zip(keys[stay].tolist(), counts[stay].tolist()))
        self.limit = max(BURST, 2 * len(self.rest))

    def _container(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(self.rest.keys(), np.int64, len(self.rest)), np.fromiter(self.rest.values(), np.int64, len(self.rest))

    def entries(self, prefix: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """All phrases of the subtree below a packed prefix, and their counts."""
        keys, counts = self._container()
        out = [(keys | prefix, counts)]
        for h, child in self.children.items():
            out += child.entries(prefix | h << self.shift)
        return out


class Tally:
    """The trie of one language in one task, and the words behind its numbers."""

    def __init__(self, lang: str, heavy: frozenset[bytes], parts: int):
        self.lang, self.heavy, self.parts = lang, heavy, parts
        self.seed = zlib.crc32(lang.encode())
        self.clear()

    def clear(self) -> None:
        self.numbers, self.root, self.size = _Numbers(), Node(2 * BITS), 0

    def add(self, words: list[bytes], carried: int = 0) -> None:
        """Count the phrases of two and three words of a run of words, but for those wholly within its first `carried` words (two at most)."""
        w = np.r_[np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), 0, 0]
        a, b, c = w[:-2], w[1:-1], w[2:]
        two = (a > 0) & (b > 0)
        three = two & (c > 0)
        pairs = a << 2 * BITS | b << BITS
        triples = (pairs | c)[three]
        if carried == 2 and len(two):
            two[0] = False
        keys, counts = np.unique(np.concatenate([pairs[two], triples]), return_counts=True)
        self.size += self.root.add(keys, counts)

    def spill(self, least: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Take out the largest subtrees until `least` entries are out: their sorted runs by partition."""
        root, out, n = self.root, [], 0
        for h, child in sorted(root.children.items(), key=lambda x: -len(x[1])):
            if n >= least:
                break
            n += len(child)
            out += child.entries(h << root.shift)
            root.children[h] = Node(root.shift - BITS)
        if n < least:
            keys, counts = root._container()
            out.append((keys, counts))
            n += len(keys)
            root.rest = {}
        keys, counts = (np.concatenate(x) for x in zip(*out))
        self.size -= n
        yield from self._runs(keys, counts)
        if len(self.numbers) > WORDS:
            if self.size:
                keys, counts = (np.concatenate(x) for x in zip(*self.root.entries()))
                yield from self._runs(keys, counts)
            self.clear()

    def _runs(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        names = list(self.numbers)  # in the order of their numbers; number 0 is the mark
        # A space behind each word makes phrases in byte order those in the order of their words.
        spaced = [w + b" " for w in names]
        rank = np.empty(len(names), np.int64)
        order = np.argsort(np.array(spaced[1:], dtype=object)) + 1 if len(names) > 1 else np.empty(0, np.int64)
        rank[0], rank[order] = 0, np.arange(1, len(names))
        ids = keys >> 2 * BITS, keys >> BITS & _LOW, keys & _LOW
        hashes = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
        heavy = np.fromiter((w in self.heavy for w in names), bool, len(names))
        part = _part(self.seed, ids, hashes, heavy, self.parts)
        sort = np.lexsort((rank[ids[0]] << 2 * BITS | rank[ids[1]] << BITS | rank[ids[2]], part))
        part, counts = part[sort], counts[sort]
        table = pa.array([None, *spaced[1:]], pa.large_binary())
        phrases = pc.binary_join_element_wise(*(table.take(pa.array(x[sort])) for x in ids), pa.scalar(b"", pa.large_binary()), null_handling="skip")
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            yield int(part[a]), phrases[a].as_py(), pack(phrases.slice(a, b - a), counts[a:b])


class _Numbers(dict):
    """Words to numbers in order of sight; the mark is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _part(seed: int, ids: tuple[np.ndarray, ...], hashes: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """The prefix partition of phrases: a hash of their words up to the first that isn't frequent."""
    mix = np.full(len(ids[0]), seed, np.uint64)
    on = np.ones(len(ids[0]), bool)
    for x in ids:
        on &= x > 0
        mix = np.where(on, (mix ^ hashes[x]) * np.uint64(0x9E3779B97F4A7C15), mix)
        mix ^= mix >> np.uint64(29)
        on &= heavy[x]
    return (mix % np.uint64(parts)).astype(np.int32)


def pack(phrases: pa.LargeBinaryArray, counts: np.ndarray) -> bytes:
    """A block of a run: counts, lengths and the phrases one after the other, compressed."""
    offsets = np.frombuffer(phrases.buffers()[1], np.int64)[phrases.offset : phrases.offset + len(phrases) + 1]
    data = memoryview(phrases.buffers()[2])[offsets[0] : offsets[-1]]
    body = counts.astype(np.int64).tobytes() + np.diff(offsets).tobytes() + bytes(data)
    return len(phrases).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blocks: list[bytes]) -> pa.Table:
    """The phrases and counts of several blocks."""
    counts, lengths, data = [], [], []
    for block in blocks:
        n, raw = int.from_bytes(block[:8], "little"), zstandard.ZstdDecompressor().decompress(block[8:])
        counts.append(np.frombuffer(raw, np.int64, n))
        lengths.append(np.frombuffer(raw, np.int64, n, 8 * n))
        data.append(raw[16 * n :])
    offsets = np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int64)
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])
    return pa.table({"p": phrases, "n": np.concatenate(counts)})


def phrase_counts(docs: DataFrame, heavy: dict[str, frozenset[bytes]], parts: int, least: int = LEAST, entries: int = ENTRIES, merge: int = 1_000_000) -> DataFrame:
    """Phrases of two and three words that occur `least` times: lang, phrase, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}

        def rows(tally: Tally, wanted: int) -> Iterator[pa.RecordBatch]:
            some: list[tuple[int, bytes, bytes]] = []
            for run in tally.spill(wanted):
                some.append(run)
                if len(some) == 256:
                    yield batch_of(tally.lang, some)
                    some = []
            if some:
                yield batch_of(tally.lang, some)

        def batch_of(lang: str, some: list) -> pa.RecordBatch:
            part, low, block = zip(*some)
            return pa.record_batch([pa.array(part, pa.int32()), pa.array([lang] * len(some)), pa.array(low, pa.binary()), pa.array(block, pa.binary())], ["part", "lang", "low", "block"])

        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in tallies:
                    tallies[lang] = Tally(lang, heavy.get(lang, frozenset()), parts)
                tally = tallies[lang]
                for words, carried in runs_of(texts):
                    tally.add(words, carried)
                    while sum(t.size for t in tallies.values()) > entries or len(tally.numbers) > WORDS:
                        largest = max(tallies.values(), key=lambda t: t.size) if len(tally.numbers) <= WORDS else tally
                        yield from rows(largest, max(1, largest.size // 2))
        for tally in tallies.values():
            if tally.size:
                yield from rows(tally, tally.size)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kept, waiting, size, limit = None, None, [], 0, merge

        def done(before: bytes | None) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            """Add up what is here; what comes before `before` is complete."""
            table = pa.concat_tables([*([kept] if kept is not None else []), *([unpack(waiting)] if waiting else [])])
            table = table.group_by("p").aggregate([("n", "sum")]).rename_columns(["p", "n"])
            rest = None
            if before is not None:
                open_ = pc.greater_equal(table["p"], pa.scalar(before, pa.large_binary()))
                table, rest = table.filter(pc.invert(open_)), table.filter(open_)
            table = table.filter(pc.greater_equal(table["n"], least))
            if not table.num_rows:
                return None, rest
            phrases = pc.binary_slice(table["p"], 0, -1).cast(pa.large_string()).cast(pa.string())
            return pa.record_batch([pa.array([place[1]] * len(phrases)), phrases.combine_chunks(), table["n"].combine_chunks()], ["lang", "phrase", "n"]), rest

        for batch in batches:
            for part, lang, low, block in zip(*(c.to_pylist() for c in batch.columns)):
                if place is not None and (part, lang) != place:
                    out, _ = done(None)
                    if out is not None:
                        yield out
                    kept, waiting, size, limit = None, [], 0, merge
                elif size > limit:
                    out, kept = done(low)
                    if out is not None:
                        yield out
                    waiting, size = [], len(kept)
                    limit = max(merge, 2 * size)
                place = part, lang
                waiting.append(block)
                size += int.from_bytes(block[:8], "little")
        if place is not None:
            out, _ = done(None)
            if out is not None:
                yield out

    runs = _texts(docs).mapInArrow(count, "part int, lang string, low binary, block binary")
    dealt = runs.repartition("part").sortWithinPartitions("part", "lang", "low")
    return dealt.mapInArrow(joined, "lang string, phrase string, n long")


def runs_of(texts: list[str | None], most: int = RUN) -> Iterator[tuple[list[bytes], int]]:
    """The words of texts in runs of some hundred thousand, a mark behind each text; a run begins with the last two words of the one before."""
    run: list[bytes] = []
    carried = 0
    for text in texts:
        for words in words_of(text):
            run += words
            if len(run) >= most:
                yield run, carried
                run = run[-2:]
                carried = len(run)
        run.append(b".")
    if len(run) > carried:
        yield run, carried


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    words = shared_table(word_counts(docs), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most HEAVY rows can each have more than one of HEAVY of all.
    frequent = words.filter(F.col("n") > total / HEAVY).select("lang", "word").collect()
    heavy: dict[str, set[bytes]] = {}
    for r in frequent:
        heavy.setdefault(r["lang"], set()).add(r["word"].encode())
    parts = max(PARTS, 2 * total // PART_PHRASES)
    phrases = shared_table(phrase_counts(docs, {k: frozenset(v) for k, v in heavy.items()}, parts, least), "phrases")

    known = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases)
    w = F.split("phrase", " ")
    first, second, third = w[0], w[1], F.get(w, F.lit(2))
    cut = lambda k, side, part: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))
    join = lambda x, y: F.concat(x, F.lit(" "), y)
    two = F.array(cut(1, "l", first), cut(1, "r", second))
    three = F.array(cut(1, "l", first), cut(1, "r", join(second, third)), cut(2, "l", join(first, second)), cut(2, "r", third))
    key = lambda c: F.concat_ws("\n", "lang", c)
    asked = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.when(F.size(w) == 2, two).otherwise(three)).alias("cut"))
    asked = asked.select("lang", "phrase", "a", "cut.*", key("cut.part").alias("key"))
    found = spread_join(asked, known.select(key("phrase").alias("key"), F.col("n").alias("f")), "key", "phrase")
    found = shared_table(found.drop("key"), "parts")

    covered = found.filter((F.instr("part", " ") > 0) & (100 * F.col("a") >= COVER * F.col("f"))).select("lang", F.col("part").alias("phrase")).distinct()
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    whole = found.groupBy("lang", "phrase", "a").agg(of(1, "l").alias("l1"), of(1, "r").alias("r1"), of(2, "l").alias("l2"), of(2, "r").alias("r2"))
    score = lambda k: F.expr(f"(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))")
    cuts = F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)))
    best = F.array_min(F.filter(cuts, lambda c: c["l"].isNotNull()))
    scored = whole.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    left = scored.join(covered, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)


def oracle() -> str:
    """The query in SQL, by lists of the words of each piece."""
    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents),
    lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
    runs AS (SELECT lang, k.k AS size, unnest(list_transform(range(1, len(w) - k.k + 2), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) AS k(k)),
    f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS w FROM runs GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}),
    cuts AS (SELECT lang, size, phrase, w, f AS a, k.k AS k, array_to_string(w[1:k.k], ' ') AS lp, array_to_string(w[k.k + 1:size], ' ') AS rp FROM c, (VALUES (1), (2)) AS k(k) WHERE k.k < size),
    scores AS (SELECT x.lang, x.size, x.phrase, x.a, x.k, l.f AS l, r.f AS r, (1000000 * x.a * x.a) // (l.f * r.f) AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covered AS (SELECT DISTINCT b.lang, b.phrase FROM c t JOIN c b ON b.lang = t.lang AND b.size = 2 AND t.size = 3 AND (b.phrase = t.w[1] || ' ' || t.w[2] OR b.phrase = t.w[2] || ' ' || t.w[3]) WHERE 100 * t.f >= {COVER} * b.f),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered))
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
