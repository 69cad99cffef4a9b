"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it into
phrases, each the longest match from where the last one ended: the automaton is followed letter by
letter and, where no arc is left, a phrase ends and the next starts at the root. The language whose
automaton needs the fewest phrases per letter wins.

An automaton has at most two states and three arcs a letter of its sample. Its arcs are packed into
one array: the arc of state s for letter c is cell base[s] + c, which also names the state it is of.
So its size doesn't depend on the number of letters that the alphabets of all languages have.

The automata are fitted on a bounded sample of labelled rows (`docs_per_lang` documents and at most
`letters_per_lang` letters of a language, `letters` letters in all) and sent to the tasks, so their
size does not grow with the input; every label that has text is learned. Texts are parsed whole. Many
stretches of `SEGMENT` letters walk in step, each as if a phrase began there; then the state at a
stretch's end is carried into the next, until it begins a phrase where the next one did too, or for as
long as it takes. Phrases and their number are those of one walk through the text.

Cases: a null text, or one without a letter, is `und` with score 0; ties go to the language first in
alphabetical order; rows with a null label or text are not learned from; without any labelled row all
texts are `und`; repeated rows are judged each by itself; other columns are not looked at; columns
named like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.llm.common import cut, map_rows

#: Bounds of the sample that the automata are fitted on: documents and letters of a language, letters in all.
DOCS_PER_LANG, LETTERS_PER_LANG, LETTERS = 48, 40_000, 4_000_000
#: Languages up to which what is known of each is broadcast.
BROADCAST_LANGS = 100_000
#: Letters of a stretch that walks in step with others; letters of a block.
SEGMENT, BLOCK_LETTERS = 256, 1 << 21
#: Free cells that are tried at once for a state's arcs.
TRIED = 32
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with each run of other characters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known, where = np.unique(points, return_inverse=True)
    folded = np.array([p if chr(p).isalpha() else 32 for p in known.tolist()], np.uint32)[where]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    return folded[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The arcs {code: state} of each state of the suffix automaton of a code sequence."""
    arcs, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return arcs


class Packed:
    """An automaton's arcs in one array of cells: cell base[s] + c is state s's arc for code c if it names s."""

    def __init__(self, arcs: list[dict[int, int]], codes: int):
        #: The state before a text and behind a letter that the sample lacks; it has no arcs.
        self.lost = len(arcs)
        self.base = np.zeros(self.lost + 1, np.int32)
        self.first = np.full(codes, self.lost, np.int32)
        for c, to in arcs[0].items():
            self.first[c] = to
        # A margin in front lets the first arc of a state stand in any cell.
        free = np.ones(codes + 2 * sum(map(len, arcs)) + codes, bool)
        free[:codes] = False
        low = codes
        owner, target = np.full(len(free), -1, np.int32), np.zeros(len(free), np.int32)
        lone = []
        for s in sorted(range(self.lost), key=lambda s: -len(arcs[s])):
            own = arcs[s]
            if len(own) < 2:
                if own:
                    lone.append(s)
                continue
            cs = np.sort(np.fromiter(own, np.int64, len(own)))
            at = low
            while True:
                spots = at + np.flatnonzero(free[at : at + 4 * TRIED])[:TRIED]
                fits = np.flatnonzero(free[np.minimum(spots[:, None] - cs[0] + cs, len(free) - 1)].all(1)) if len(spots) else spots
                if len(fits):
                    break
                at = int(spots[-1]) + 1 if len(spots) else at + 4 * TRIED
                low = at  # crowded cells are left to states of one arc
                if at + codes >= len(free):
                    grown = len(free)
                    free = np.concatenate([free, np.ones(grown, bool)])
                    owner, target = np.concatenate([owner, np.full(grown, -1, np.int32)]), np.concatenate([target, np.zeros(grown, np.int32)])
            base = int(spots[fits[0]] - cs[0])
            self.base[s] = base
            free[base + cs], owner[base + cs] = False, s
            target[base + cs] = [own[c] for c in cs.tolist()]
        spots = np.flatnonzero(free)
        spots = np.concatenate([spots, np.arange(len(free), len(free) + max(0, len(lone) - len(spots)))])[: len(lone)]
        size = max(len(free), int(spots[-1]) + 1 if len(spots) else 0)
        owner = np.concatenate([owner, np.full(size - len(owner), -1, np.int32)])
        target = np.concatenate([target, np.zeros(size - len(target), np.int32)])
        for s, spot in zip(lone, spots.tolist()):
            ((c, to),) = arcs[s].items()
            self.base[s], owner[spot], target[spot] = spot - c, s, to
        end = int(np.flatnonzero(owner >= 0)[-1]) + 1 if (owner >= 0).any() else 0
        # A cell holds the state that it is of and the one that it leads to; behind the last there is room for any code.
        self.cells = np.full(end + codes + 1, -1, np.int64)
        self.cells[:end] = np.where(owner[:end] >= 0, owner[:end].astype(np.int64) << 32 | target[:end], -1)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind a letter, and whether a phrase begins with it."""
        got = self.cells[self.base[state] + code]
        begins = got >> 32 != state
        return np.where(begins, self.first[code], got.astype(np.int32)), begins

    @property
    def nbytes(self) -> int:
        return self.cells.nbytes + self.base.nbytes + self.first.nbytes


def shares(lengths: list[int], total: int) -> list[int]:
    """How many of `total` letters each document gives: the same, and what shorter ones leave goes to the longer ones."""
    out, left = [0] * len(lengths), total
    for n, k in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[k] = min(lengths[k], left // (len(lengths) - n))
        left -= out[k]
    return out


def taken_letters(texts: list[str], most: int) -> np.ndarray:
    """`most` letters at most of some texts, shared out evenly over them."""
    parts = [_letters(t) for t in texts]
    return np.concatenate([p[:n] for p, n in zip(parts, shares(list(map(len, parts)), most))] or [np.zeros(0, np.uint32)])


class Model:
    """The automata of all languages over one alphabet; code 0 stands for letters that no sample has."""

    def __init__(self, samples: dict[str, list[str]], letters_per_lang: int = LETTERS_PER_LANG, letters: int = LETTERS):
        most = min(letters_per_lang, letters // max(1, len(samples)))
        self._build({lang: taken_letters(texts, most) for lang, texts in sorted(samples.items())})

    @classmethod
    def of_letters(cls, taken: dict[str, str]) -> Model:
        """The model of letters that are already taken from the samples of each language."""
        own = cls.__new__(cls)
        own._build({k: np.frombuffer(taken[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in sorted(taken)})
        return own

    def _build(self, taken: dict[str, np.ndarray]) -> None:
        self.langs = [x for x in taken if len(taken[x])]
        self.alphabet = np.unique(np.concatenate([taken[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint32)
        self.automata = [Packed(suffix_automaton((np.searchsorted(self.alphabet, taken[x]) + 1).tolist()), len(self.alphabet) + 1) for x in self.langs]

    def _codes(self, text: str) -> np.ndarray:
        points = _letters(text)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text (row) needs in each language (column)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        block, owner, size = [], [], 0
        # Stretches of a text that is cut by a block's end go on from the states there.
        states = [a.lost for a in self.automata]
        for k, text in enumerate(texts):
            codes = self._codes(text)
            for at in range(0, len(codes), SEGMENT):
                block.append(codes[at : at + SEGMENT])
                owner.append(k)
                size += SEGMENT
                if size >= BLOCK_LETTERS:
                    ends = self._walk(block, owner, states, out)
                    states = ends if at + SEGMENT < len(codes) else [a.lost for a in self.automata]
                    block, owner, size = [], [], 0
        if block:
            self._walk(block, owner, states, out)
        return out

    def _walk(self, block: list[np.ndarray], owner: list[int], states: list[int], out: np.ndarray) -> list[int]:
        """Count the phrases of stretches, the first of which goes on from `states`, into `out`; the states at the end of the last."""
        lengths = np.array([len(b) for b in block])
        order = np.argsort(-lengths, kind="stable")
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        grid = np.zeros((SEGMENT, len(block)), np.int32)
        for k, b in enumerate(block):
            grid[: len(b), column[k]] = b
        lengths = lengths[order]
        live = np.searchsorted(-lengths, -np.arange(SEGMENT), "left")
        who = np.array(owner)
        # The stretches, in order, that go on from the one before them.
        later = np.flatnonzero(who[1:] == who[:-1]) + 1
        ends = []
        for lang, automaton in enumerate(self.automata):
            state = np.full(len(block), automaton.lost, np.int32)
            state[column[0]] = states[lang]
            began = np.zeros(grid.shape, bool)
            for step in range(SEGMENT):
                n = live[step]
                if not n:
                    break
                state[:n], began[step, :n] = automaton.step(state[:n], grid[step, :n])
            count = began.sum(0)
            todo = later
            while len(todo):
                todo = todo[self._carry(automaton, grid, lengths, began, count, state, column[todo - 1], column[todo])] + 1
                todo = todo[np.isin(todo, later)]
            np.add.at(out[:, lang], who, count[column])
            ends.append(int(state[column[-1]]))
        return ends

    @staticmethod
    def _carry(automaton, grid, lengths, began, count, state, before, here) -> np.ndarray:
        """Walk the stretches `here` from the states at the end of those `before`, until they begin a phrase where they did so too.

        Their counts, phrases and end states are set right; returns which end states changed.
        """
        now, changed = state[before], np.zeros(len(here), bool)
        live = np.arange(len(here))
        for step in range(SEGMENT):
            live = live[lengths[here[live]] > step]
            if not len(live):
                break
            at = here[live]
            now[live], starts = automaton.step(now[live], grid[step, at])
            met = starts & began[step, at]
            count[at] += starts.astype(np.int64) - began[step, at]
            began[step, at] = starts
            over = live[(lengths[at] == step + 1) & ~met]
            changed[over] = now[over] != state[here[over]]
            state[here[over]] = now[over]
            live = live[~met]
        return changed

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and a score from 0 to 1 that grows with its lead over the next one."""
        live = [k for k, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if live:
            for k, counts in zip(live, self.phrases([texts[k] for k in live])):
                best = int(np.argmin(counts))
                rest = np.delete(counts, best)
                score = float(rest.min() / (rest.min() + counts[best])) if len(rest) else 1.0
                out[k] = (self.langs[best], min(1.0, 2 * score - 1) if len(rest) else 1.0)
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, letters_per_lang: int = LETTERS_PER_LANG, letters: int = LETTERS) -> Model:
    """Fit on a bounded sample of every language: the documents with the smallest text hashes.

    The choice depends on the texts alone, and a text that repeats is taken once. Documents are cut to their shares
    in the tasks, so the driver gets `letters` letters in all, however many languages there are.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # Hashes first, texts after. Distinct hashes are even, so a bound on them leaves about 32 times the wanted
    # documents of a language, however large it is; the ranking then sees that many rows and moves no text.
    share = F.least(F.lit(1.0), 32 * docs_per_lang / F.col("n"))
    bound = F.when(share < 1, (F.lit(-(2.0**63)) + share * 2.0**64).cast("long")).otherwise(F.lit(2**63 - 1))
    bounds = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", bound.alias("bound")))
    languages = bounds.count()
    if not languages:
        return Model({})
    # A row a language, and some for each of its documents; beyond a hundred thousand languages they are shuffled.
    held = F.broadcast if languages <= BROADCAST_LANGS else (lambda df: df)
    few = rows.select("lang", "h").join(held(bounds), "lang").filter("h <= bound").select("lang", "h").distinct()
    chosen = cut(few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= docs_per_lang).select("lang", "h"))
    picked = rows.join(held(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, letters_per_lang)).alias("text"))
    most = min(letters_per_lang, letters // languages)

    def share_out(key: tuple, table: pa.Table) -> pa.Table:
        """The letters of one language: some dozen documents, cut, come in."""
        taken = taken_letters(table.sort_by("h")["text"].to_pylist(), most)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "text": pa.array([taken.tobytes().decode("utf-32-le", "surrogatepass")], pa.string())})

    own = picked.groupBy("lang").applyInArrow(share_out, "lang string, text string").collect()
    return Model.of_letters({r["lang"]: r["text"] for r in own})


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, and language and score under `names`, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in names]
    fields = [docs.schema[c] for c in keep]
    text = f"text_{uuid.uuid4().hex}"  # a name that no column has

    def make():
        own = shared.value

        def block(rows):
            for r, found in zip(rows, own.predict([r.pop(text) for r in rows])):
                r.update(zip(names, found))
            return rows

        return block

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{names[0]}` string, `{names[1]}` double"])
    return map_rows(docs.select(*keep, F.col(text_col).alias(text)), make, schema, rows=1000)


def fold(id_col: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))
