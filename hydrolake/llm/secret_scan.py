"""Secret scans through a trigram index.

Each rule is a regular expression. Its syntax tree gives a Boolean query over trigrams that
every match must contain. A block of documents is indexed by those trigrams (postings: trigram
to the rows that hold it), the postings are intersected and united as the query says, and only
the candidate rows are verified with the expression itself. A rule without mandatory trigrams
verifies every row. The index is partitioned by document, so nothing is shuffled.

Cases: a null text is an empty text and has no span; repeated rows are scanned each by itself;
texts of any length are scanned whole; other columns of the input are ignored by `scan` and
kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.common import map_rows

ANY: tuple = ("any",)
#: Alternatives kept while the exact strings of a subexpression are multiplied out.
MAX_EXACT = 64
#: Bytes that one index block holds.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, and the least length of a group (0: whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base rules and public credential formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    # A key up to its END line; where that is missing (before the next BEGIN), headers and lines of base64 with a last shorter one.
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]+={0,2}(?=\s|\\[nr]|-----|\Z))?)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    # One attempt for each run of token letters, so runs of "eyJ" take linear time; what stands before it in the run belongs to the span.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
)


def _all(parts: list[tuple]) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _one_of(parts: list[tuple]) -> tuple:
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _strings(exact: set[str]) -> tuple:
    """The trigrams that one of the strings brings; any if a string is too short to have one."""
    found = []
    for s in sorted(exact):
        b = s.encode().lower()
        found.append(_all([("tri", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2)]))
    return _one_of(found)


def _sequence(parsed) -> tuple[set[str] | None, tuple]:
    """The exact strings of an expression if they are few, and the query that its matches fulfil."""
    exact, need, whole = {""}, [], True
    for op, arg in parsed:
        part, query = _item(op, arg)
        if part is not None and len(exact) * len(part) <= MAX_EXACT:
            exact = {a + b for a in exact for b in part}
            continue
        need += [_strings(exact), query if part is None else ANY]
        exact, whole = part or {""}, False
    return (exact, ANY) if whole else (None, _all([*need, _strings(exact)]))


def _item(op, arg) -> tuple[set[str] | None, tuple]:
    if op is rc.LITERAL:
        return {chr(arg)}, ANY
    if op is rc.AT:
        return {""}, ANY
    if op is rc.IN and len(arg) <= 6 and all(o is rc.LITERAL for o, _ in arg):
        return {chr(c) for _, c in arg}, ANY
    if op in (rc.SUBPATTERN, rc.ATOMIC_GROUP):
        return _sequence(arg[3] if op is rc.SUBPATTERN else arg)
    if op is rc.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts) and len(both := set().union(*(e for e, _ in parts))) <= MAX_EXACT:
            return both, ANY
        return None, _one_of([q if e is None else _strings(e) for e, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if least == most == 1:
            return exact, query
        return None, ANY if least == 0 else query if exact is None else _strings(exact)
    return None, ANY


def trigram_query(pattern: str) -> tuple:
    """A tree of ("any",), ("tri", n), ("and", ...), ("or", ...) that every match of `pattern` fulfils.

    Trigrams are of UTF-8 bytes with A-Z folded, so the query also holds for case-insensitive rules.
    """
    exact, query = _sequence(rp.parse(pattern, re.ASCII))
    return query if exact is None else _strings(exact)


def _trigrams(query: tuple) -> set[int]:
    return {query[1]} if query[0] == "tri" else set().union(set(), *(_trigrams(q) for q in query[1:]))


class BlockIndex:
    """Postings of the wanted trigrams over the rows of one block."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        """`wanted`: True for each of the 2**24 trigrams that some rule asks for."""
        data = np.frombuffer(b"\0\0\0".join(texts), np.uint8).astype(np.int32)
        ends = np.cumsum([len(t) + 3 for t in texts])
        self.rows = np.arange(len(texts))
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        grams = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(wanted[grams])
        pairs = np.unique(grams[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right"))
        keys = pairs >> 32
        for gram in np.unique(keys):
            lo, hi = np.searchsorted(keys, [gram, gram + 1])
            self.postings[int(gram)] = pairs[lo:hi] & 0xFFFFFFFF

    def candidates(self, query: tuple) -> np.ndarray:
        if query == ANY:
            return self.rows
        if query[0] == "tri":
            return self.postings.get(query[1], self.rows[:0])
        found = [self.candidates(q) for q in query[1:]]
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, True) if query[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    """Finds the spans of all rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # A run of one class is maximal, so its least length can be asked for in the expression.
        runs = [f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and r.least else r.pattern for r in rules]
        self.compiled = [re.compile(x, re.ASCII) for x in runs]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[sorted(set().union(set(), *map(_trigrams, self.queries)))] = True

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, end, rule number), by start and then in the rules' order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        block: list[int] = []
        size = 0
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        for i, b in enumerate(coded):
            block.append(i)
            size += len(b)
            if size >= BLOCK_BYTES or i == len(coded) - 1:
                index = BlockIndex([coded[k] for k in block], self.wanted)
                for n, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
                    for row in index.candidates(query):
                        k = block[row]
                        found[k] += [(*m.span(), n) for m in regex.finditer(texts[k]) if len(m.group(rule.group)) >= rule.least]
                block, size = [], 0
        return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and `spans`, an array of (kind, start, end, base), by start and then kind.

    Offsets count code points and the end is exclusive.
    """
    ids = docs.schema[id_col].dataType
    kinds = [(r.kind, r.base) for r in rules]

    def make():
        scanner = Scanner(rules)

        def block(rows):
            found = scanner.spans([r["text"] or "" for r in rows])
            return [{"id": r["id"], "spans": [{"kind": kinds[n][0], "start": a, "end": b, "base": kinds[n][1]} for a, b, n in s]} for r, s in zip(rows, found)]

        return block

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = f"id {ids.simpleString()}, spans array<{span.simpleString()}>"
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found span replaced by `mark`; overlapping spans are replaced together."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def make():
        scanner = Scanner(rules)

        def block(rows):
            for row, spans in zip(rows, scanner.spans([r[text_col] or "" for r in rows])):
                text, out, at = row[text_col], [], 0
                for a, b, _ in spans:
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                if spans:
                    row[text_col] = "".join([*out, text[at:]])
            return rows

        return block

    return map_rows(docs, make, to_arrow_schema(docs.schema))


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns: counts by base kind, hash of the base spans, all spans as text."""
    shown = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return spans.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))
