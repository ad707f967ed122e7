"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validity test are permuted, with a key, within the set of valid values
of the same format: a card number becomes another that passes the Luhn test, a date another date, an
address another address. The permutation is a Feistel network over two mixed-radix halves, so equal values
get equal pseudonyms in all documents and different values different ones. Separators, field widths and letter
case stay. What counts as one value:

* Mail addresses are equal if they are so without regard to case. The name and the labels of the domain but the last
  are permuted, each letter within its script's block, so one domain stays one domain.
* Phone numbers are equal if their digits are; the country is read from the digits, by the lengths of country codes,
  and stays. Numbers in the North American national form count as those of country 1.
* Dates are equal in all forms. They stay within spans of 200 years, and days and months within 1-9, 10-12 and 13-31,
  so that widths stay and a day can be told from a month as well as before. Where either may be the day, the first is.
* Card and account numbers, IBANs, US social security numbers and IPv4 addresses are equal if their digits and letters are.

A permutation may map a value to itself, with a chance of one in the size of its format.

Null text: no findings, null text out. Empty text: no findings. Repeated rows: repeated results.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_texts

ROUNDS = 10
KINDS = ("email", "iban", "card", "account", "phone", "ssn", "ip", "date")

_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ymd>(?<![0-9./-])[0-9]{4}([./-])[0-9]{1,2}\5[0-9]{1,2}(?![0-9]|[./-][0-9]))"
    r"|(?P<dmy>(?<![0-9./-])[0-9]{1,2}([./-])[0-9]{1,2}\7[0-9]{4}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9](?:(?:[ .-]|[ .-]?\(0\)[ .-]?|[ .-]?\(|\)[ .-]?)?[0-9]){6,14}(?![0-9]))"
    r"|(?P<american>(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<trunk>(?<![0-9.+/-])0[1-9][0-9]{1,4}(?:[ /-][0-9]{2,8}){1,4}(?![0-9]))"
    r"|(?P<number>(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9]))"
)
_MAYBE = re.compile(r"[0-9@]")

# Country codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")

#: Days and months stay within these.
DAY_CLASSES = ((1, 9), (10, 12), (13, 31))
SPAN_YEARS = 200


class Feistel:
    """A keyed permutation of range(size): unbalanced halves, cycle-walked where size has no product form."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _f(self, tweak: str, i: int, side: int, below: int) -> int:
        data = f"{tweak}|{i}|{side}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % below

    def permute(self, value: int, a: int, b: int, tweak: str) -> int:
        """A permutation of range(a * b)."""
        left, right = divmod(value, b)
        for i in range(self.rounds):
            if i % 2:
                right = (right + self._f(tweak, i, left, b)) % b
            else:
                left = (left + self._f(tweak, i, right, a)) % a
        return left * b + right

    def invert(self, value: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(value, b)
        for i in reversed(range(self.rounds)):
            if i % 2:
                right = (right - self._f(tweak, i, left, b)) % b
            else:
                left = (left - self._f(tweak, i, right, a)) % a
        return left * b + right

    def within(self, value: int, size: int, tweak: str, valid=lambda v: True, back: bool = False) -> int:
        """A permutation of the valid part of range(size): steps until it meets a valid value again."""
        a = max(1, int(size**0.5))
        b = -(-size // a)
        step = self.invert if back else self.permute
        value = step(value, a, b, tweak)
        while value >= size or not valid(value):
            value = step(value, a, b, tweak)
        return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(payload: str) -> str:
    return next(c for c in "0123456789" if luhn(payload + c))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _ssn_ok(v: int) -> bool:
    area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


class Pseudonymizer:
    """Finds values and replaces them; ``back`` turns pseudonyms into the values again."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def number(self, digits: str, tweak: str, valid=lambda d: True) -> str:
        """Permutes digit strings of one length: those that are valid among themselves, and so the others."""
        n, kind = len(digits), valid(digits)
        made = self.feistel.within(int(digits), 10**n, f"{tweak}{n}{kind}", lambda v: valid(str(v).zfill(n)) == kind, back=self.back)
        return str(made).zfill(n)

    def mixed(self, text: str, tweak: str) -> str:
        """Permutes characters, each within its class and without regard to case, as one number; others stay."""
        places = []
        for i, c in enumerate(text):
            low = _lower(c)
            members = _class_of(low)
            if len(members) > 1:
                places.append((i, members, members.index(low), low != c))
        if not places:
            return text
        cut = len(places) // 2
        halves = (places[:cut], places[cut:])
        sizes, values = [], []
        for half in halves:
            size, value = 1, 0
            for _, members, v, _ in half:
                size, value = size * len(members), value * len(members) + v
            sizes.append(size)
            values.append(value)
        shape = list(text)
        for i, members, _, _ in places:
            shape[i] = members[0]
        step = self.feistel.invert if self.back else self.feistel.permute
        made = divmod(step(values[0] * sizes[1] + values[1], *sizes, f"{tweak}|{''.join(shape)}"), sizes[1])
        out = list(text)
        for half, value in zip(halves, made):
            for i, members, _, upper in reversed(half):
                value, v = divmod(value, len(members))
                out[i] = members[v].upper() if upper else members[v]
        return "".join(out)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        made = self.mixed(name, "domain" + _folded(top))
        known = made if self.back else name
        return f"{self.mixed(local, 'email@' + _folded(known + '.' + top))}@{made}.{top}"

    def date(self, value: datetime.date) -> datetime.date:
        """A date of the same span of years, class of day and class of month."""
        span = (value.year - 100) // SPAN_YEARS
        first = max(1, 100 + span * SPAN_YEARS)
        years = min(10_000, 100 + (span + 1) * SPAN_YEARS) - first
        day = next(c for c in DAY_CLASSES if c[0] <= value.day <= c[1])
        month = next(c for c in DAY_CLASSES if c[0] <= value.month <= c[1])
        days, months = day[1] - day[0] + 1, month[1] - month[0] + 1

        def parts(v: int) -> tuple[int, int, int]:
            rest, d = divmod(v, days)
            y, m = divmod(rest, months)
            return first + y, month[0] + m, day[0] + d

        def real(v: int) -> bool:
            try:
                return bool(datetime.date(*parts(v)))
            except ValueError:
                return False

        at = ((value.year - first) * months + value.month - month[0]) * days + value.day - day[0]
        return datetime.date(*parts(self.feistel.within(at, years * months * days, f"date{span}|{day[0]}|{month[0]}", real, back=self.back)))

    def phone(self, digits: str) -> str:
        """Digits with the country code."""
        head = next((c for c in (digits[:1], digits[:2]) if c in ONE_DIGIT or c in TWO_DIGITS), digits[:3])
        rest = digits[len(head) :]
        if not rest:
            return digits
        valid = _american if head == "1" and len(rest) == 10 else lambda d: d[0] != "0"
        return head + self.number(rest, f"phone{head}|", valid)

    def replace(self, kind: str, text: str) -> tuple[str, str] | None:
        """Kind and pseudonym of a candidate; None where it fails its test."""
        digits = re.sub("[^0-9]", "", text)
        if kind == "email":
            if all(len(_class_of(_lower(c))) < 2 for c in text.rpartition(".")[0]):
                return None
            return "email", self.email(text)
        if kind == "iban":
            plain = text.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
                return None
            body = self.mixed(plain[4:], "iban" + plain[:2])
            check = 98 - iban_rest(plain[:2] + "00" + body)
            return "iban", _refill(text, f"{plain[:2]}{check:02d}{body}")
        if kind == "ip":
            parts = [int(p) for p in text.split(".")]
            if max(parts) > 255:
                return None
            v = self.feistel.within(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back=self.back)
            return "ip", ".".join(map(str, v.to_bytes(4, "big")))
        if kind in ("ymd", "dmy"):
            fields = re.split(r"[./-]", text)
            x, y, z = (int(f) for f in fields)
            # A first field that can be no day makes it month-day-year; a second one that can be no month, too.
            order = (0, 1, 2) if kind == "ymd" else (2, 0, 1) if y > 12 else (2, 1, 0)
            try:
                made = self.date(datetime.date(*((x, y, z)[i] for i in order)))
            except ValueError:
                return None
            out = [""] * 3
            for i, v in zip(order, (made.year, made.month, made.day)):
                out[i] = str(v).zfill(len(fields[i]))
            sep = re.search(r"[./-]", text)[0]
            return "date", sep.join(out)
        if kind == "ssn":
            if not _ssn_ok(int(digits)):
                return None
            made = self.feistel.within(int(digits), 10**9, "ssn", _ssn_ok, back=self.back)
            return "ssn", _refill(text, f"{made:09d}")
        if kind == "phone":
            trunk = text.find("(0)")
            if trunk >= 0:
                digits = re.sub("[^0-9]", "", text.replace("(0)", "", 1))
            if not 7 <= len(digits) <= 15:
                return None
            made = self.phone(digits)
            if trunk < 0:
                return "phone", _refill(text, made)
            cut = sum(c.isdigit() for c in text[:trunk])
            return "phone", _refill(text[:trunk], made[:cut]) + "(0)" + _refill(text[trunk + 3 :], made[cut:])
        if kind == "american":
            return ("phone", _refill(text, self.phone("1" + digits)[1:])) if _american(digits) else None
        if kind == "trunk":
            if not 9 <= len(digits) <= 12:
                return None
            return "phone", _refill(text, "0" + self.number(digits[1:], "trunk", lambda d: d[0] != "0"))
        if kind == "number":
            if not 12 <= len(digits) <= 19:
                return None
            if luhn(digits):
                body = self.number(digits[:-1], "card")
                return "card", _refill(text, body + luhn_digit(body))
            return "account", _refill(text, self.number(digits, "account", luhn))
        return None

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end of each value in the text as it was."""
        if not _MAYBE.search(text):
            return text, []
        out, found, at = [], [], 0
        for m in _FIND.finditer(text):
            made = self.replace(m.lastgroup, m[0])
            if made:  # what fails its test stays
                out += [text[at : m.start()], made[1]]
                found.append((made[0], m.start(), m.end()))
                at = m.end()
        return ("".join(out) + text[at:] if found else text), found


def _american(digits: str) -> bool:
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def _lower(c: str) -> str:
    """The lower-case letter that stands for one of either case; others, and those that have no way back, stay."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


def _folded(text: str) -> str:
    return "".join(map(_lower, text))


@lru_cache(maxsize=65536)
def _class_of(c: str) -> str:
    """Digits or letters that may take the place of one: those of its kind and block, lower-case ones with a way back."""
    kind = unicodedata.category(c)
    if kind == "Nd":
        first = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(first, first + 10)))
    if kind not in ("Ll", "Lo", "Lt", "Lu", "Lm"):
        return ""
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz"
    return _block(ord(c) // 128, kind, _paired(c))


def _paired(c: str) -> bool:
    up = c.upper()
    return up != c and len(up) == 1 and up.lower() == c


@lru_cache(maxsize=4096)
def _block(number: int, kind: str, paired: bool) -> str:
    return "".join(c for c in map(chr, range(number * 128, number * 128 + 128)) if not c.isascii() and unicodedata.category(c) == kind and _paired(c) == paired and _lower(c) == c)


def _refill(text: str, chars: str) -> str:
    """Puts characters in place of the letters and digits of a text."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in text)


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, text with pseudonyms, n_pii, found (array of kind, start, end in the given text)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("text", T.StringType()), T.StructField("n_pii", T.LongType()), T.StructField("found", T.ArrayType(span))]

    def make():
        p = Pseudonymizer(key, back)

        def run(texts: list) -> list[list]:
            done = [(None, []) if t is None else p.apply(t) for t in texts]
            return [
                [t for t, _ in done],
                [len(f) for _, f in done],
                [[{"kind": k, "start": s, "end": e} for k, s, e in f] for _, f in done],
            ]

        return run

    given = as_texts(docs, id_col, text_col).select("doc_id", F.col("text").alias("given"))
    return append_columns(given, ["given"], fields, make).drop("given")
