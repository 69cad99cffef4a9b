"""Log probabilities of documents under a subword lattice, beside a word base line.

A word is `▁` and its characters. Its lattice has an arc for every piece of an existing vocabulary that
stands in it, bytes where a character is no piece, and one arc over the whole word if it was seen in
training. The word's probability is the sum over all paths, by forward recursion on logarithms; a
document's is the product over its words and the end.

Pieces begin with the scores of the vocabulary's file. Where these are ranks of merges, a rank r counts
as the weight 1 / (r + `RANK_SHIFT`). They are then fitted to the training words by expected counts over
all segmentations (`ROUNDS` passes over the distinct words), with `PRIOR` pseudo-counts shared out by the
file's scores. The whole-word arc has the discounted relative frequency (c - d) / N, and the paths of
pieces share what the discount leaves, d V / N; that is d for each distinct word, so each counts once in
the fit. d is n1 / (n1 + 2 n2) from the words seen once and twice. So tokens have probabilities that add
up to 1 at most.

Documents are packed in blocks of some tokens: a block has a row with the numbers of its tokens, and a row for each of
its distinct words. Counts and word probabilities go to the blocks by joins of these words, never a
document's tokens. Words with more than one of `HEAVY` of all tokens (`HEAVY` rows at most) are broadcast;
all others are joined by shuffle.

Cases: a null or empty text has the end only; repeated rows count as often as they stand there; without
training rows base and word arcs are empty and pieces have the file's scores; a null id is held out; texts and words of any length are taken whole,
and a block holds whole documents; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import shared_table

#: Weight of a vocabulary's ranks, pseudo-counts, passes of the fit, added count of the base line.
RANK_SHIFT, PRIOR, ROUNDS, ADDED = 100, 100.0, 2, 0.1
#: Tokens of a block, bytes of a text read at once, most frequent words that are broadcast.
BLOCK, CHUNK, HEAVY = 4_000_000, 1 << 20, 65_536
SPACE = "▁"
#: Stands for a space sign within a word; and bits of a piece's number.
OWN_SPACE, NUMBER = "\udfff", 26

_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, some of them at a time."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()  # at the blanks of ASCII, which are those of the contract
        at = end


@dataclass
class Pieces:
    """Log weights (natural) of the pieces that begin a word, of those within, of single bytes, and of the end."""

    first: dict[str, float]
    inner: dict[str, float]
    byte: list[float]
    end: float

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a sentencepiece file with their scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        named = [(model.id_to_piece(i), model.get_score(i), i) for i in ids]
        plain = [(p, s) for p, s, i in named if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # Ranks are whole numbers that go down by one; scores of a unigram model are logarithms.
        ranked = all(s == int(s) for _, s in plain)
        weight = (lambda s: -math.log(RANK_SHIFT - s)) if ranked else (lambda s: s)
        first = {p: weight(s) for p, s in plain if p[0] == SPACE and SPACE not in p[1:]}
        inner = {p: weight(s) for p, s in plain if SPACE not in p}
        least = min([*first.values(), *inner.values()], default=0.0)
        return cls(first, inner, [least] * 256, least).normal()

    def normal(self) -> Pieces:
        """With weights that add up to 1."""
        all_ = [*self.first.values(), *self.inner.values(), *self.byte, self.end]
        most = max(all_)
        total = most + math.log(math.fsum(math.exp(x - most) for x in all_))
        down = lambda d: {k: v - total for k, v in d.items()}
        return Pieces(down(self.first), down(self.inner), [x - total for x in self.byte], self.end - total)

    def names(self) -> list[tuple[str, float]]:
        """All pieces and their log weights; kinds are told apart by a letter in front."""
        return [*((f"f{k}", v) for k, v in self.first.items()), *((f"i{k}", v) for k, v in self.inner.items()), *((f"b{k:02x}", v) for k, v in enumerate(self.byte)), ("e", self.end)]

    def with_counts(self, counts: dict[str, float], prior: float = PRIOR) -> Pieces:
        """The weights that expected counts and this model's pseudo-counts give."""
        counts = by_byte(counts)
        new = {k: math.log(counts.get(k, 0.0) + prior * math.exp(v)) for k, v in self.names()}
        pick = lambda d, kind: {k: new[kind + k] for k in d}
        return Pieces(pick(self.first, "f"), pick(self.inner, "i"), [new[f"b{k:02x}"] for k in range(256)], new["e"]).normal()

    @property
    def inside(self) -> float:
        """The weight of all pieces that go on with a word."""
        return math.fsum(map(math.exp, [*self.inner.values(), *self.byte]))

    def tables(self) -> tuple[ahocorasick.Automaton | None, list[str], list[float]]:
        """The machine that finds all pieces, each with its length and number; names and log weights by number."""
        if not hasattr(self, "_tables"):
            names, weights, machine = [], [], ahocorasick.Automaton()
            for kind, own in (("f", self.first), ("i", self.inner)):
                for piece, w in own.items():
                    machine.add_word(piece, len(piece) << NUMBER | len(names))
                    names.append(kind + piece)
                    weights.append(w)
            if names:
                machine.make_automaton()
            self._tables = (machine if names else None, names, weights)
        return self._tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def lattices(self, words: list[str]) -> Lattices:
        """The arcs of all words' lattices; nodes of all words are numbered through.

        Words stand in one text, each behind a space. No piece has a space but at its beginning, so none goes over
        the end of a word; a space within a word is written as a sign that no text has.
        """
        machine, names, weights = self.tables()
        text = SPACE + SPACE.join(w.replace(SPACE, OWN_SPACE) if SPACE in w else w for w in words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        found = np.fromiter((e << 34 | v for e, v in machine.iter(text)) if machine else (), np.int64)
        target, length, piece = (found >> 34) + 1, found >> NUMBER & 0xFF, found & (1 << NUMBER) - 1
        # Characters that are no piece go by their bytes, as does a space that is none.
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, which = np.unique(points, return_inverse=True)
        chars = [chr(k) for k in kinds.tolist()]
        bare = np.array([c not in (self.first if c == SPACE else self.inner) for c in chars])
        spots = np.flatnonzero(bare[which])
        codes = [(SPACE if c == OWN_SPACE else c).encode("utf-8", "surrogatepass") for c in chars]
        target = np.r_[target, spots + 1]
        length = np.r_[length, np.ones(len(spots), np.int64)]
        piece = np.r_[piece, len(names) + which[spots]]
        every = np.array([*weights, *(sum(self.byte[b] for b in c) for c in codes)])
        word = np.searchsorted(begins, target - 1, "right") - 1  # each word has one node more than characters
        starts = begins + np.arange(len(words))
        return Lattices(starts, int(sizes.sum()) + len(words), target - length + word, target + word, piece, every, [*names, *("b" + c.hex() for c in codes)])

    def forward(self, words: list[str]) -> np.ndarray:
        """The log of the sum over all segmentations of each word; that of the end for no word."""
        own = [w for w in words if w]
        out = np.full(len(words), self.end - math.log1p(-min(self.inside, 1 - 1e-12)))
        if own:
            out[[bool(w) for w in words]] = self.lattices(own).totals()
        return out

    def expected(self, words: list[str]) -> dict[str, float]:
        """The expected counts of the pieces over all segmentations of each word."""
        out = {"e": float(sum(not w for w in words))}
        if own := [w for w in words if w]:
            found = self.lattices(own)
            counts = found.counts()
            for k in np.flatnonzero(counts).tolist():  # a space within words has the same bytes as one before them
                out[found.names[k]] = out.get(found.names[k], 0.0) + counts[k]
        return by_byte(out)


@dataclass
class Lattices:
    """The lattices of some words: the first node of each, how many nodes, and each arc's ends and piece."""

    starts: np.ndarray
    nodes: int
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    weights: np.ndarray
    names: list[str]

    def _levels(self, at: np.ndarray, other: np.ndarray, back: bool) -> np.ndarray:
        """Sums of the ways to each node in log space: arcs go from `other` to `at`, all nodes of one depth at a time."""
        bounds = np.r_[self.starts, self.nodes]
        ends = bounds[1:] - 1
        logs = np.full(self.nodes, -np.inf)
        logs[ends if back else self.starts] = 0.0
        word = np.searchsorted(self.starts, at, "right") - 1
        depth = ends[word] - at if back else at - self.starts[word]
        order = np.lexsort((at, depth))
        at, other, w, depth = at[order], other[order], self.weights[self.piece[order]], depth[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # of one depth nodes are apart, so a node is one run
        cuts = np.searchsorted(depth[new], np.arange(1, int(depth[-1]) + 2)) if len(depth) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            begin, end = new[a], new[b] if b < len(new) else len(at)
            runs = new[a:b] - begin
            terms = logs[other[begin:end]] + w[begin:end]
            most = np.maximum.reduceat(terms, runs)
            sums = np.add.reduceat(np.exp(terms - np.repeat(most, np.diff(np.r_[runs, end - begin]))), runs)
            logs[at[new[a:b]]] = most + np.log(sums)
        return logs

    def totals(self) -> np.ndarray:
        logs = self._levels(self.target, self.source, False)
        return logs[np.r_[self.starts[1:], self.nodes] - 1]

    def counts(self) -> np.ndarray:
        """The expected number of each piece over all words."""
        there, back = self._levels(self.target, self.source, False), self._levels(self.source, self.target, True)
        word = np.searchsorted(self.starts, self.source, "right") - 1
        whole = there[np.r_[self.starts[1:], self.nodes] - 1]
        share = np.exp(there[self.source] + self.weights[self.piece] + back[self.target] - whole[word])
        return np.bincount(self.piece, share, len(self.names))


def by_byte(counts: dict[str, float]) -> dict[str, float]:
    """Expected counts with those of characters in bytes under each byte."""
    out: dict[str, float] = {}
    for name, n in counts.items():
        for own in [name] if name[0] != "b" else ["b" + name[k : k + 2] for k in range(1, len(name), 2)]:
            out[own] = out.get(own, 0.0) + n
    return out


def _some(batch: pa.RecordBatch, most: int = 200_000) -> Iterator[list[str]]:
    """The words of a batch, some hundred thousand characters at a time."""
    some, size = [], 0
    for word in batch.column(0).to_pylist():
        some.append(word)
        size += len(word) + 1
        if size > most:
            yield some
            some, size = [], 0
    if some:
        yield some


def blocks_of(docs: DataFrame, held: Column, block: int = BLOCK) -> DataFrame:
    """Documents in blocks: a row a block with ids and token numbers, and a row for each of its words with its training count.

    A block is named by its task and its number there; the rows are to be written before they are read twice.
    """
    schema = "block long, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, at int, word string, c long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.string(), pa.int64()]
        names = ["block", "ids", "held", "sizes", "tokens", "at", "word", "c"]
        name = TaskContext.get().partitionId() << 33
        numbers, ids, flags, sizes, arrays, total = _Numbers(), [], [], [], [], 0

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([columns.get(x, pa.nulls(n, t)) for x, t in zip(names, types)], names)

        def out() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(arrays)
            trained = np.repeat(~np.array(flags, bool), sizes)
            counts = np.bincount(flat[trained], minlength=len(numbers))
            tokens = zstandard.ZstdCompressor(level=1).compress(flat.tobytes())
            own = {"block": pa.array([name]), "ids": pa.array([ids], types[1]), "held": pa.array([flags], types[2]), "sizes": pa.array([sizes], types[3]), "tokens": pa.array([tokens], types[4])}
            yield rows(1, **own)
            words = pa.array(list(numbers), pa.binary()).cast(pa.string())
            for a in range(0, len(words), 20_000):
                n = len(words.slice(a, 20_000))
                yield rows(n, block=pa.array([name] * n), at=pa.array(range(a, a + n), pa.int32()), word=words.slice(a, n), c=pa.array(counts[a : a + n]))

        for batch in batches:
            for i, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                size = 0
                for words in words_of(text.as_py()):
                    found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    arrays.append(found)
                    size += len(found)
                arrays.append(np.zeros(1, np.int32))  # the end
                ids.append(i)
                flags.append(bool(flag))
                sizes.append(size + 1)
                total += size + 1
                if total >= block:
                    yield from out()
                    name += 1
                    numbers, ids, flags, sizes, arrays, total = _Numbers(), [], [], [], [], 0
        if ids:
            yield from out()

    return docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(run, schema)


class _Numbers(dict):
    """Words to numbers in order of sight; the end is 0."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def fit(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The pieces fitted to distinct words (the empty word is the end)."""
    model = pieces
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Pieces = model) -> Iterator[pa.RecordBatch]:
            found: dict[str, float] = {}
            for batch in batches:
                for some in _some(batch):
                    for k, n in now.expected(some).items():
                        found[k] = found.get(k, 0.0) + n
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["piece", "n"])

        summed = words.select("word").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        model = pieces.with_counts({r["piece"]: r["n"] for r in summed.collect()})  # a row a piece of the vocabulary at most
    return model


def score(docs: DataFrame, held: Column, pieces: Pieces, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """The log10 probability of every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = shared_table(blocks_of(docs, held, block), "blocks")
    blocks, pairs = table.filter(F.col("tokens").isNotNull()), table.filter(F.col("word").isNotNull()).select("block", "at", "word", "c")
    counted = shared_table(pairs.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct, once, twice = counted.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model = fit(counted.filter("c > 0"), pieces, rounds)
    base_down = math.log10(total + ADDED * (distinct + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = math.log(discount * distinct / total) if total else 0.0
        for batch in batches:
            paths = np.concatenate([model.forward(some) for some in _some(batch)]) + left if batch.num_rows else np.empty(0)
            c = batch.column(1).to_numpy()
            own = np.where(c > 0, np.log(np.where(c > 0, c - discount, 1.0) / max(total, 1)), -np.inf)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.logaddexp(paths, own) / math.log(10))], ["word", "c", "full"])

    weighed = shared_table(counted.select("word", "c").mapInArrow(weigh, "word string, c long, full double"), "weights")
    frequent = F.col("c") > total / HEAVY
    hot = F.broadcast(weighed.filter(frequent))  # HEAVY rows at most: each has more than one of HEAVY of the tokens
    known = pairs.drop("c").join(hot, "word", "left")
    met = known.filter(F.col("full").isNotNull()).unionByName(known.filter(F.col("full").isNull()).select("block", "word", "at").join(weighed.filter(~frequent), "word"))
    # A block's words are as many as its tokens at most.
    packed = met.groupBy("block").agg(F.collect_list(F.struct("at", "c", "full")).alias("found"))
    packed = packed.select("block", F.col("found.at").alias("at"), F.col("found.c").alias("c"), F.col("found.full").alias("full"))
    joined = blocks.select("block", "ids", "held", "sizes", "tokens").join(packed, "block")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, flags, sizes, tokens, at, c, full = (batch.column(x)[k] for x in ("ids", "held", "sizes", "tokens", "at", "c", "full"))
                n = sizes.values.to_numpy()
                place = at.values.to_numpy()
                counts, logs = np.empty(len(place)), np.empty(len(place))
                counts[place], logs[place] = c.values.to_numpy(), full.values.to_numpy()
                starts = np.r_[0, np.cumsum(n)[:-1]]
                flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens.as_py()), np.int32)
                sums = lambda x: np.add.reduceat(x[flat], starts)  # noqa: B023, E731
                out = [ids.values, flags.values, pa.array(n), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(n), total)), pa.array(sums(np.log10(counts + ADDED) - base_down)), pa.array(sums(logs))]
                yield pa.record_batch(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
