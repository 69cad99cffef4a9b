"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A found value is validated (check digit, calendar, numbering rules), written as a number below the
size N of its format's domain, and permuted within 0..N-1 by a keyed Feistel network: halves of base
ceil(sqrt(N)), rounds of keyed BLAKE2b, and walking along the cycle until the result is below N. Values
of more than `LONG` characters are cut into blocks, and each block is permuted in two passes, forth and
back, under a key of its number and all blocks before it in the pass, so every character bears on every
other. The result is written back in the same format, so it is again a valid value, separators and length stay,
and equal values get equal pseudonyms in every document. With the key the step can be undone.

Cases: null texts stay null; empty texts and texts without values stay as they are; values that fail
validation are left alone; repeated rows get equal results; whole texts are read; all columns of the
input are kept, but for those named like a count, which it replaces; an empty table gives no rows.

Dates with slashes are read as day/month/year and, where that is no date, as month/day/year. Equal
days are linked across the formats of four-digit years with all digits; dates with one-digit days or
months and those that are month/day only are permuted among dates of their own kind.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from hydrolake.llm.common import map_rows

ROUNDS = 8
#: Characters that are permuted as one number, and those of a block of a longer value.
LONG, BLOCK = 48, 32
KINDS = ("card", "phone", "ssn", "ip", "date", "email")
#: Kinds that are counted as another.
COUNTED = {"abroad": "phone"}
# The formats. Each kind is a group of its name; the first alternative that fits wins.
FORMATS = (
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<phone>(?<![\w.])(?:\+?1[ .-])?\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.+-])(?:\+?1[ .-])?\d{3}(?:[.-]\d{3}[.-]|[ ]\d{3}[ ])\d{4}(?![\w-]))"
    r"|(?P<abroad>(?<![\w.+-])\+[2-9]\d{0,2}(?:[ .-]\d{2,5}){2,5}(?![\w-])|(?<![\w.+-])\+[2-9]\d{8,14}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}(?:-\d{2}-|[ ]\d{2}[ ])\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))"
)
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache
def _days(swapped: bool, short_day: bool, short_month: bool) -> list[int]:
    """The dates that can be written with a day or month of one digit; swapped ones have a day that is no month."""

    def fits(n: int) -> bool:
        d = datetime.date.fromordinal(n)
        return (d.day > 12 or not swapped) and (d.day < 10 or not short_day) and (d.month < 10 or not short_month)

    return [n for n in range(FIRST, LAST + 1) if fits(n)]


class Feistel:
    """Keyed permutations of 0..N-1, one for each kind and N."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, k: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}:{n}:{k}:{half}".encode(), key=self.key, digest_size=32).digest())

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """The image of x, or with `back` the value whose image is x."""
        if not 0 <= x < n:
            raise ValueError(f"{x} is not below {n}")
        base = math.isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, base)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = ((b - self._round(kind, n, k, a)) % base, a) if back else (b, (a + self._round(kind, n, k, b)) % base)
            x = a * base + b
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum of the Luhn rule modulo 10; 0 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _mixed(digits: list[int], radices: list[int]) -> int:
    x = 0
    for d, r in zip(digits, radices):
        x = x * r + d
    return x


def _unmixed(x: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _fill(shape: str, digits: str) -> str:
    """The digits of `shape` replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """Finds, validates and replaces values."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.find = re.compile(FORMATS, re.ASCII)
        self.known: dict[tuple[str, str], str | None] = {}

    def _digits(self, kind: str, digits: list[int], radices: list[int]) -> list[int]:
        if len(digits) > LONG:
            return self._blocks(kind, digits, radices)
        n = math.prod(radices)
        return _unmixed(self.feistel.permute(kind, n, _mixed(digits, radices), self.back), radices)

    def _blocks(self, kind: str, digits: list[int], radices: list[int]) -> list[int]:
        """A long value: blocks of even length, permuted one after the other, first forth and then back (undone: the reverse)."""
        count = -(-len(digits) // BLOCK)
        cuts = [k * len(digits) // count for k in range(count + 1)]
        spans = list(zip(cuts, cuts[1:]))
        digits = list(digits)
        for sweep in (1, 0) if self.back else (0, 1):
            # The chain is over permuted blocks, which both directions know.
            chain = hashlib.blake2b(f"{kind}:{sweep}:{len(digits)}".encode(), digest_size=16)
            for k in range(count) if sweep == 0 else range(count - 1, -1, -1):
                a, b = spans[k]
                n, x = math.prod(radices[a:b]), _mixed(digits[a:b], radices[a:b])
                new = self.feistel.permute(f"{kind}:{sweep}:{k}:{chain.hexdigest()}", n, x, self.back)
                chain.update(f"{x if self.back else new},".encode())
                digits[a:b] = _unmixed(new, radices[a:b])
        return digits

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = "".join(map(str, self._digits("card", list(map(int, digits[:-1])), [10] * (len(digits) - 1))))
        return _fill(value, body + str(-luhn(body + "0") % 10))

    def phone(self, value: str) -> str | None:
        digits = list(map(int, re.sub(r"\D", "", value)))
        lead, own = digits[:-10], digits[-10:]
        if own[0] < 2 or own[3] < 2:
            return None
        low = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        new = self._digits("phone", [d - a for d, a in zip(own, low)], [10 - a for a in low])
        return _fill(value, "".join(map(str, lead + [d + a for d, a in zip(new, low)])))

    def abroad(self, value: str) -> str | None:
        """Numbers of other countries: the country's digits stay, which are those before the first separator, else two."""
        digits = re.sub(r"\D", "", value)
        lead = re.match(r"\d{1,3}(?=[ .-])", value[1:])
        kept = len(lead[0]) if lead else 2
        if not 8 <= len(digits) <= 15:
            return None
        own = list(map(int, digits[kept:]))
        return _fill(value, digits[:kept] + "".join(map(str, self._digits("abroad", own, [10] * len(own)))))

    def ssn(self, value: str) -> str | None:
        area, group, serial = map(int, re.split("[ -]", value))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        area, group, serial = self._digits("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        return _fill(value, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return ".".join(map(str, self._digits("ip", list(map(int, parts)), [256] * 4)))

    def date(self, value: str) -> str | None:
        parts = re.split(r"[/.-]", value)
        if len(parts[0]) == 4:
            orders = ((2, 1, 0),)
        else:
            orders = ((0, 1, 2), (1, 0, 2)) if "/" in value else ((0, 1, 2),)
        for order in orders:
            day, month, year = (int(parts[k]) for k in order)
            try:
                found = datetime.date(year, month, day).toordinal()
            except ValueError:
                continue
            if not FIRST <= found <= LAST:
                continue
            swapped, short = order == (1, 0, 2), (len(parts[order[0]]) == 1, len(parts[order[1]]) == 1)
            if not swapped and not any(short):
                new = FIRST + self.feistel.permute("date", LAST - FIRST + 1, found - FIRST, self.back)
            else:
                days = _days(swapped, *short)
                new = days[self.feistel.permute(f"date:{swapped}:{short}", len(days), bisect_left(days, found), self.back)]
            made = datetime.date.fromordinal(new)
            shown = dict(zip(order, (made.day, made.month, made.year)))
            return _fill(value, "".join(f"{shown[k]:0{len(parts[k])}d}" for k in range(3)))
        return None

    def email(self, value: str) -> str | None:
        """The local part is permuted, letters among letters of their case and digits among digits."""
        local, at, domain = value.partition("@")
        if not re.search("[A-Za-z0-9]", local):
            return None
        spots = [(c, 26 if c.isalpha() else 10, ord("a" if c.islower() else "A" if c.isalpha() else "0")) for c in local if c.isalnum()]
        new = iter(self._digits("email", [ord(c) - low for c, _, low in spots], [r for _, r, _ in spots]))
        lows = iter(low for _, _, low in spots)
        return "".join(chr(next(lows) + next(new)) if c.isalnum() else c for c in local) + at + domain

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with its values replaced, and how many of each kind were."""
        counts: dict[str, int] = {}
        if not text or not re.search("[0-9@]", text):
            return text, counts

        def new(m: re.Match) -> str:
            spot = (m.lastgroup, m.group())
            if spot not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[spot] = getattr(self, spot[0])(spot[1])
            if self.known[spot] is None:
                return spot[1]
            kind = COUNTED.get(spot[0], spot[0])
            counts[kind] = counts.get(kind, 0) + 1
            return self.known[spot]

        return self.find.sub(new, text), counts


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """The rows with their text replaced, and a count n_<kind> for each kind. `back` undoes an earlier run."""
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    out = StructType(list(docs.schema.fields))
    for k in KINDS:
        out = out.add(f"n_{k}", LongType(), False)

    def make():
        own = Pseudonyms(key, back)

        def block(rows):
            for r in rows:
                r[text_col], counts = own.replace(r[text_col])
                r.update({f"n_{k}": counts.get(k, 0) for k in KINDS})
            return rows

        return block

    return map_rows(docs, make, to_arrow_schema(out))
