"""BPE encoding and decoding with a tokenization automaton.

The automaton's arcs are labelled with tokens, and it accepts exactly the token sequences that the
merges produce. It starts as one state that loops on every base symbol. Each merge (u, v), in rank
order, adds a gadget at the state q that u leads to: u is redirected to a copy of q without the arc
for v, and every state with an arc for u gains an arc for uv to where v led. All arcs of a token lead
to one state, so a state is kept as its parent and the one arc that it lacks, and an arc's presence is
looked up along that chain; answers are tabled.

A pre-split word is encoded by following arcs from each reached position: every prefix of a word has
one correct tokenization, so a position is reached by one arc only. Decoding emits the labels of the
arcs. Vocabularies are read, never trained, and sent to the tasks (their size is fixed).

Cases: a null or empty text has no tokens and decodes to an empty text; special tokens in a text are
their own ids; words of any length are encoded whole; repeated rows are encoded each by itself; other
columns are passed through if named in `keep`.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The White_Space property, and the expression that splits words.
SPACE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
# Letters and numbers of Unicode 17, which the tokenizers library (Unicode 16) takes for neither, and
# lower-case letters of Unicode 16 and 17, which Python's tables lack.
UNICODE_17 = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
LOWER_LATE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Entries that a task's tables keep before they start anew.
KEPT_WORDS, KEPT_LETTERS, KEPT_ARCS = 400_000, 64, 1_000_000


def byte_letters() -> str:
    """The printable character of each byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


def splitters() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The expression that splits words, a slower one that leaves out Unicode 17, and one that finds texts that need the latter."""
    late = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in UNICODE_17.split())
    exact = SPLIT.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]", rf"[[^{SPACE}\p{{L}}\p{{N}}]{late}]").replace(r"\p{L}+", rf"[\p{{L}}--[{late}]]+").replace(r"|\p{N}|", rf"|[\p{{N}}--[{late}]]|")
    rare = late + "".join(f"\\U{c:08x}" for c in LOWER_LATE)
    return regex.compile(SPLIT), regex.compile(exact, regex.V1), regex.compile(f"[{rare}]")


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100, where all tables agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Automaton:
    """The merge automaton over token ids, with state 0 as its start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        size = max(vocab.values()) + 1
        self.left, self.born = array("i", [-1] * size), array("i", [-1] * size)
        self.leads, self.dead = array("i", [0] * size), bytearray(size)
        self.parent, self.lacks, self.made = array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.table: dict[int, bool] = {}
        self.inner, self.final, self.starts = {}, {}, set()
        self.labels = [""] * size
        for i, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if self.left[uv] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[uv], self.born[uv] = u, i
            q = self.leads[u]
            if self.dead[u] or self.dead[v] or not self.allows(q, v):
                self.dead[uv] = 1  # no state has u before v, so the merge never happens
                continue
            self.leads[uv] = self.leads[v]
            self.parent.append(q)
            self.lacks.append(v)
            self.made.append(i)
            self.leads[u] = len(self.parent) - 1
        self.table.clear()
        for text, t in vocab.items():
            self.labels[t] = text
            if not self.dead[t]:
                end = text.endswith(suffix)
                body = text[: -len(suffix)] if end else text
                (self.final if end else self.inner)[body] = t
                self.starts.update(body[:k] for k in range(1, len(body) + 1))
        self.longest = max(map(len, self.starts))

    def allows(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        key = state << 20 | token
        if (known := self.table.get(key)) is not None:
            return known
        s, t = state, token
        out = True
        while s:
            if self.born[t] >= self.made[s]:
                t = self.left[t]  # the arc was added where its left part had one
            elif t == self.lacks[s]:
                out = False
                break
            else:
                s = self.parent[s]
        if len(self.table) >= KEPT_ARCS:
            self.table.clear()
        self.table[key] = out
        return out

    def encode(self, word: str) -> list[int]:
        """The token ids of one word, given in byte letters."""
        n = len(word)
        state, arc = [-1] * (n + 1), [(0, 0)] * (n + 1)
        state[0] = 0
        inner, final, starts, leads, allows, longest = self.inner, self.final, self.starts, self.leads, self.allows, self.longest
        for j in range(n):
            s = state[j]
            if s < 0:
                continue
            for k in range(j + 1, min(n, j + longest) + 1):
                piece = word[j:k]
                if piece not in starts:
                    break
                if state[k] < 0:
                    t = (inner if k < n else final).get(piece)
                    if t is not None and allows(s, t):
                        state[k], arc[k] = leads[t], (j, t)
        out = []
        while n:
            n, t = arc[n]
            out.append(t)
        return out[::-1]


class Tokenizer:
    """Normalisation, splitting and the automaton of a tokenizer file of the supported form."""

    def __init__(self, file: dict):
        model = file["model"]
        steps = [s["type"] for s in file["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or file["decoder"]:
            raise ValueError("the file is not of the supported form: word-end BPE over NFC, one space and lower case")
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        labels = self.automaton.labels
        labels += [""] * (max([len(labels) - 1, *self.special.values()]) + 1 - len(labels))
        for text, t in self.special.items():
            labels[t] = text
        self._ready()

    def _ready(self) -> None:
        self.split, self.exact, self.rare = splitters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.words: dict[str, list[int]] = {}

    def __getstate__(self):
        return {"automaton": self.automaton, "special": self.special}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._ready()

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _word(self, word: str) -> list[int]:
        ids = self.automaton.encode("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))))
        if len(word) <= KEPT_LETTERS:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words, new = self.words, self._word
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each letter is lower-cased by itself: no final sigma
            find = self.split
            if not _latin(part) and self.rare.search(part):
                part, find = part.translate(LOWER_LATE), self.exact
            for word in find.findall(part.lower()):
                out += words.get(word) or new(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids; the file has no decoder, so they are joined by a space."""
        labels = self.automaton.labels
        return " ".join([labels[t] for t in ids])


def encode(docs: DataFrame, tokenizer: Tokenizer, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, `ids` (array of token ids) and `decoded` (their decoded text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in keep if c not in ("ids", "decoded")]
    out = StructType([docs.schema[c] for c in keep]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    schema = to_arrow_schema(out)

    def run(batches):
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                ids = [own.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [*batch.columns[:-1], pa.array(ids, schema.field("ids").type), pa.array([own.decode(x) for x in ids], schema.field("decoded").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)
