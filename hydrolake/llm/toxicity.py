"""Toxicity scores from a learned weighted lexicon, matched by Aho-Corasick.

Texts are folded first: compatibility forms, case, look-alike letters of other scripts and digits or
signs that stand for letters inside a word; all else is one space. The lexicon has whole words and
beginnings of words whose rates in labelled toxic and clean documents differ enough, with their log
odds as weights. An automaton over all entries finds them in the folded text; an occurrence inside an
exception phrase does not count: phrases that are given, and those learned, two words with an entry that
stand in clean labelled documents and never in toxic ones. The score is a logistic function of the weights found, as a sum and
normalised by the text's length.

Lexicon and function are fitted on a bounded sample of labelled rows (`TRAIN_ROWS`); scoring reads
every row and whole texts.

Cases: a null or empty text finds nothing and has the score of a text without entries; without
labelled rows of both kinds nothing is learned and every score is 0; repeated rows score equally and
are learned from once, as is an id with several texts (its smallest one); rows without a label or id
are scored and not learned from; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import cut, map_rows

#: Bound: labelled rows that are learned from. All entries and exceptions that they hold are kept.
TRAIN_ROWS = 30_000
#: An entry needs so many toxic documents and so large a log odds ratio, an exception so many clean documents.
LEAST_TOXIC, LEAST_WEIGHT, LEAST_CLEAN = 3, 3.0, 3
PREFIXES = range(3, 8)

# Look-alikes of Latin letters, and signs used for letters inside words.
LOOKALIKES = dict(zip("аеорсхуікмтвнјѕԁгԛԝαοερτυικνχβ", "aeopcxyikmtbhjsdrqwaoeptuikvxb"))
SIGNS = dict(zip("013457@$!|", "oieastasil"))
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "clownfish", "sore loser", "pond scum", "not stupid", "not worthless")


def fold(text: str | None) -> str:
    """The folded words, each with a space before and after."""
    text = unicodedata.normalize("NFKC", text or "").lower().translate(_LOOK)
    words = []
    for raw in re.split(r"\s+", text):
        if not raw:
            continue
        if _SIGN.search(raw) and _LETTER.search(raw):
            # A sign between letters, or before one, stands for a letter; at the end it is punctuation.
            body = raw.rstrip("!|.,;:?")
            raw = body.translate(_MAP)
        words += _WORD.findall(raw)
    return f" {' '.join(words)} " if words else " "


_LOOK = str.maketrans(LOOKALIKES)
_MAP = str.maketrans(SIGNS)
_SIGN, _LETTER, _WORD = re.compile(r"[013457@$!|]"), re.compile(r"[^\W\d_]"), re.compile(r"[^\W_]+")


def terms(folded: str) -> set[str]:
    """The candidate entries of a folded text: its words, and their beginnings with a space before."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = field(default=(-4.0, 1.0, 0.0))

    def __post_init__(self):
        self._build()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._build()

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            self.machine.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            self.machine.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(self.machine):
            self.machine.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """The weights found, once for each word of the text, as a sum and over the logarithm of its words."""
        folded = fold(text)
        hits, free = [], []
        if len(self.machine):
            for end, (size, w) in self.machine.iter(folded):
                (free if w is None else hits).append((end - size + 1, end, w))
        # Of the exception phrases that begin at a place or before it, how far the farthest goes.
        free.sort()
        begins, reach = [a for a, _, _ in free], list(accumulate((b for _, b, _ in free), max))
        best: dict[int, float] = {}
        for start, end, w in hits:
            k = bisect_right(begins, start)
            if not k or reach[k - 1] < end:
                best[start] = max(w, best.get(start, 0.0))
        found: dict[str, float] = {}
        for start, w in best.items():
            found[folded[start : folded.index(" ", start + 1) + 1]] = w
        total = sum(found.values())
        return total, total / np.log(np.e + folded.count(" "))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        total, dense = self.features(text)
        a, b, c = self.coefficients
        return float(1 / (1 + np.exp(-np.clip(a + b * total + c * dense, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression with intercept, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def phrases(lexicon: Lexicon, folded: str) -> set[str]:
    """The phrases of two words of a folded text that hold an entry of the lexicon."""
    words = folded.split()
    marked = {k for k, w in enumerate(words) if f" {w} " in lexicon.weights or any(f" {w[:n]}" in lexicon.weights for n in PREFIXES if n < len(w))}
    return {f"{words[a]} {words[a + 1]}" for k in marked for a in (k - 1, k) if 0 <= a < len(words) - 1}


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Fit on the `train_rows` labelled rows (doc_id, toxic) with the smallest hashes of their ids.

    Contradicting labels of one id are left out, and an id is one row, however often it stands in
    `docs`. Counts of terms and phrases are summed by Spark; the driver gets the entries, the exceptions and
    two numbers for each labelled row, all bounded by the sample.
    """
    spark = docs.sparkSession
    clean = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    rows = clean.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    if not rows:
        return Lexicon({})
    known = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, toxic int")), "doc_id")
    train = cut(known.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    counts = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts[0] or not counts[1]:
        return Lexicon({})

    def make_terms():
        def block(part):
            out: dict[str, list[int]] = {}
            for r in part:
                for t in terms(fold(r["text"])):
                    out.setdefault(t, [0, 0])[r["toxic"]] += 1
            return [{"term": t, "n0": a, "n1": b} for t, (a, b) in out.items()]

        return block

    sums = map_rows(train, make_terms, "term string, n0 long, n1 long", rows=1000).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # Each term's log odds: a half document is added to each count.
    weight = F.log((F.col("n1") + 0.5) / (counts[1] + 1)) - F.log((F.col("n0") + 0.5) / (counts[0] + 1))
    strong = sums.filter(F.col("n1") >= LEAST_TOXIC).withColumn("w", weight).filter(F.col("w") >= LEAST_WEIGHT)
    lexicon = Lexicon({r["term"]: float(r["w"]) for r in strong.select("term", "w").orderBy("term").collect()})
    entries = spark.sparkContext.broadcast(lexicon)

    def make_phrases():
        own = entries.value

        def block(part):
            out: dict[str, list[int]] = {}
            for r in part:
                for t in phrases(own, fold(r["text"])):
                    out.setdefault(t, [0, 0])[r["toxic"]] += 1
            return [{"term": t, "n0": a, "n1": b} for t, (a, b) in out.items()]

        return block

    pairs = map_rows(train, make_phrases, "term string, n0 long, n1 long", rows=1000).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    free = sorted(r["term"] for r in pairs.filter((F.col("n1") == 0) & (F.col("n0") >= LEAST_CLEAN)).select("term").collect())
    lexicon = Lexicon(lexicon.weights, (*EXCEPTIONS, *(t for t in free if t not in EXCEPTIONS)))
    shared = spark.sparkContext.broadcast(lexicon)

    def make_features():
        own = shared.value

        def block(part):
            return [dict(zip(("total", "dense"), own.features(r["text"])), toxic=r["toxic"]) for r in part]

        return block

    seen = map_rows(train, make_features, "total double, dense double, toxic int").collect()  # a row for each row of the sample
    seen.sort(key=lambda r: (r["total"], r["dense"], r["toxic"]))  # sums in one order
    x, y = np.array([[r["total"], r["dense"]] for r in seen]), np.array([r["toxic"] for r in seen], float)
    lexicon.coefficients = tuple(map(float, logistic(x, y)))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        own = shared.value

        def block(rows):
            return [{"doc_id": r["doc_id"], "score": own.score(r["text"])} for r in rows]

        return block

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, score double")
