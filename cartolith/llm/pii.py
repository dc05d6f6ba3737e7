"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by shape and validated (Luhn, mod 97, calendar, number plan, octets); what fails
its test is left alone. A valid value is the integer of its place among all valid values of its
format, and a keyed Feistel network with cycle walking permutes that set. So a pseudonym is a
valid value of the same format and length, equal values get equal pseudonyms in all documents,
different ones never collide, and the key's holder can go back.

Kinds: e-mail (local part, letter by letter and digit by digit; letters beyond ASCII become letters
of the same alphabet; rare ones stay), IPv4, IPv6 (in full, or ``::`` between three groups and more), phone numbers (North American plan,
and ``+`` with a country code), payment cards, US social security numbers, IBANs (of groups that
follow each other, the length that the country fixes, else the longest run that passes its check),
dates (``2024-02-29``, ``2024/02/29``, ``29.02.2024``, ``29-02-2024``, ``02/29/2024``; from 1900 to
2099). Other digits stay: ten digits without a mark between them are taken for no phone number, as
nothing tells them from other numbers, and names of persons are found by no shape.

The key: ``secret_key`` takes it from ``CARTOLITH_PII_KEY``; where that isn't set it draws one for
this process, so pseudonyms are linked within a run, and no one can undo them or link two runs.

Edge cases: a null text stays null with 0 values; repeated rows and equal texts give equal
results; a null ``doc_id`` and extra columns, whatever their names, stay as they are; an empty
table gives no rows. Texts of any length are scanned whole.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import secrets
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartolith.llm.common import map_rows, prepare
from cartolith.progress import log

ROUNDS = 8
_ANY = re.compile("[0-9@]")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Longer local parts are permuted in pieces of this length.
_EMAIL_PIECE = 64
#: Latin, Greek and Cyrillic letters beyond ASCII, which local parts and hosts may have. Other scripts
#: are written without blanks, so what stands beside an address there isn't part of it.
_MORE = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u052f"
_MORE_LETTER = re.compile(f"[{_MORE}]")
_LABEL = f"[A-Za-z0-9{_MORE}](?:[A-Za-z0-9{_MORE}\\-]*[A-Za-z0-9{_MORE}])?"
_EMAIL_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z{_MORE}]{{2,}}")
#: Small letters beyond ASCII that are permuted, in one alphabet each.
_ALPHABETS = [[c for c in map(chr, block) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c] for block in (range(0xDF, 0x180), range(0x3B1, 0x3CA), range(0x430, 0x460))]
_LETTER_AT = {c: (a, i) for a, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}
#: Where a value may begin: a digit, plus or bracket, two capitals before digits, or the first group of an IPv6 address.
_START = re.compile(r"(?<![0-9])[0-9+(]|(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2})|(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?=:[0-9A-Fa-f:])")
#: The shapes of values, in the order they are tried at a place.
_SHAPES = [(kind, re.compile(shape)) for kind, shape in (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    ("iso", r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"),
    ("dmy", r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])"),
    ("mdy", r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"),
    ("ymd", r"(?<![0-9/])[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?![0-9/])"),
    ("dash", r"(?<![0-9\-])[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}(?![0-9\-])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("nanp", r"(?<![0-9+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9\-])"),
    ("phone", r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ \-]?\(?[0-9]{1,5}\)?){2,5}(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9+])\+[1-9][0-9]{0,2}[ \-]?[0-9]{2,5}[ \-]?[0-9]{4,9}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9\-])[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9\-])"),
    ("card", r"(?<![0-9\-])[0-9]{4}([ \-])[0-9]{6}\1[0-9]{5}(?![0-9\-])"),
    ("card", r"(?<![0-9\-])[0-9]{13,19}(?![0-9\-])"),
)]
#: The characters of an IBAN, by country.
_IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}
#: Values that a worker remembers.
REMEMBERED = 200_000


class Feistel:
    """A keyed permutation of ``range(n)``, different for each format."""

    def __init__(self, key: bytes):
        self._key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, fmt: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        told = bytes([i]) + len(fmt).to_bytes(2, "little") + fmt + half.to_bytes(size, "little")
        out, n = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(told + bytes([n]), key=self._key, digest_size=min(64, size)).digest()
            n += 1
        return int.from_bytes(out[:size], "little") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, fmt: str, back: bool = False) -> int:
        """The image of ``x`` below ``n``; with ``back`` the value whose image it is."""
        if not 0 <= x < n:
            raise ValueError("outside the format")
        if n == 1:
            return 0
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, tag = (1 << bits) - 1, f"{fmt}|{n}".encode()
        while True:
            a, b = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._f(tag, i, a, bits), a
                else:
                    a, b = b, a ^ self._f(tag, i, b, bits)
            x = a << bits | b
            if x < n:
                return x


def _mixed(feistel: Feistel, digits: list[int], radices: list[int], fmt: str, back: bool) -> list[int]:
    """Permutes a number with a radix for each place."""
    x, n = 0, 1
    for d, r in zip(digits, radices):
        x, n = x * r + d, n * r
    x = feistel.permute(x, n, fmt, back)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def luhn_digit(payload: str) -> int:
    """The check digit of a card number without it."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """Puts digits in the places of a shape's digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(f: Feistel, s: str, back: bool) -> str | None:
    d = _digits(s)
    if d[0] == "0" or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    inner = "".join(map(str, _mixed(f, [int(c) for c in d[1:-1]], [10] * (len(d) - 2), f"card{d[0]}", back)))
    return _fill(s, d[0] + inner + str(luhn_digit(d[0] + inner)))


def _ip(f: Feistel, s: str, back: bool) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    least = {1: 0, 2: 10, 3: 100}
    radices = [{1: 10, 2: 90, 3: 156}[len(o)] for o in octets]
    fmt = "ip" + "".join(str(len(o)) for o in octets)
    new = _mixed(f, [int(o) - least[len(o)] for o in octets], radices, fmt, back)
    return ".".join(str(v + least[len(o)]) for v, o in zip(new, octets))


def _ip6(f: Feistel, s: str, back: bool) -> str | None:
    """Groups keep their number of digits; a group has no needless zero in front, or all four digits."""
    groups = s.split(":")
    told = [g for g in groups if g]
    if ("::" in s and not 3 <= len(told) <= 7) or not any(c.isdigit() for c in s):
        return None
    digits, radices, shape = [], [], ""
    for g in groups:
        for i, c in enumerate(g):
            first = i == 0 and 1 < len(g) < 4
            if first and c == "0":
                return None
            digits.append(int(c, 16) - first)
            radices.append(16 - first)
            shape += "f" if first else "x"
        shape += ":"
    new, k, out = _mixed(f, digits, radices, "ip6" + shape, back), 0, []
    upper = any(c in "ABCDEF" for c in s)
    for c, place in zip(s, shape):
        if c == ":":
            out.append(c)
        else:
            out.append(f"{new[k] + (place == 'f'):{'X' if upper else 'x'}}")
            k += 1
    return "".join(out)


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = (int(p) for p in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    a, g, n = _mixed(f, [place, group - 1, serial - 1], [898, 99, 9999], "ssn", back)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _nanp(f: Feistel, s: str, back: bool) -> str | None:
    """Ten digits. Numbers that the plan doesn't assign count only when written as phone numbers, and stay such."""
    d = _digits(s)
    lead, d = d[:-10], d[-10:]
    assigned = lambda x: x[0] not in "01" and x[3] not in "01"
    if not assigned(d) and not lead and "(" not in s:
        return None
    x, kind = int(d), assigned(d)
    while True:
        x = f.permute(x, 10**10, "nanp", back)
        if assigned(new := f"{x:010d}") == kind:
            return _fill(s, lead + new)


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    d = _digits(s)
    if not 8 <= len(d) <= 15 or s.count("(") != s.count(")"):
        return None
    new = _mixed(f, [int(c) for c in d[3:]], [10] * (len(d) - 3), f"phone{d[:3]}", back)
    return _fill(s, d[:3] + "".join(map(str, new)))


def _iban_runs(s: str) -> list[str]:
    """The runs of groups that an IBAN in groups may be: the length its country fixes, then the longest first."""
    runs = [s]
    while " " in runs[-1]:
        runs.append(runs[-1].rpartition(" ")[0])
    size = _IBAN_SIZES.get(s[:2])
    return sorted((r for r in runs if len(r.replace(" ", "")) >= 15), key=lambda r: len(r.replace(" ", "")) != size)


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    plain = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    radices = [10 if c.isdigit() else 26 for c in body]
    new = _mixed(f, [int(c) if c.isdigit() else ord(c) - 65 for c in body], radices, "iban" + plain[:2] + "".join("d" if r == 10 else "a" for r in radices), back)
    body = "".join(str(v) if r == 10 else chr(65 + v) for v, r in zip(new, radices))
    out = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    it = iter(out)
    return "".join(" " if c == " " else next(it) for c in s)


#: Kinds that are told apart only by their shape.
_NAMES = {"iso": "date", "dmy": "date", "mdy": "date", "ymd": "date", "dash": "date", "nanp": "phone", "ip6": "ip"}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


def _date(order: str, mark: str) -> Callable[[Feistel, str, bool], str | None]:
    def permuted(f: Feistel, s: str, back: bool) -> str | None:
        parts = s.split(mark)
        at = {k: int(p) for k, p in zip(order, parts)}
        if any(len(p) == 1 and p == "0" for p in parts) or not 1900 <= at["y"] <= 2099:
            return None
        try:
            x = datetime.date(at["y"], at["m"], at["d"]).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        while True:
            x = f.permute(x, _DAYS, "date", back)
            day = datetime.date.fromordinal(x + _FIRST_DAY)
            new = [str({"y": day.year, "m": day.month, "d": day.day}[k]) for k in order]
            if _form(parts) == _form([n.zfill(len(p)) for n, p in zip(new, parts)]):
                return mark.join(n.zfill(len(p)) for n, p in zip(new, parts))

    return permuted


def _form(parts: list[str]) -> tuple:
    """What a date's pseudonym shares with it: the widths, where some part has one digit."""
    widths = tuple(map(len, parts))
    return widths if 1 not in widths else (widths, tuple(p[0] == "0" for p in parts))


def _email(f: Feistel, local: str, host: str, back: bool) -> str:
    if len(local) > _EMAIL_PIECE:
        pieces = range(0, len(local), _EMAIL_PIECE)
        return "".join(_email(f, local[i : i + _EMAIL_PIECE], f"{host}#{len(local)}#{i}", back) for i in pieces)
    radices, digits, shape = [], [], []
    for c in local:
        low = c.lower()
        if "a" <= low <= "z":
            radices.append(26)
            digits.append(ord(low) - 97)
            shape.append("A" if c != low else "a")
        elif "0" <= c <= "9":
            radices.append(10)
            digits.append(int(c))
            shape.append("9")
        elif low in _LETTER_AT:
            block, place = _LETTER_AT[low]
            radices.append(len(_ALPHABETS[block]))
            digits.append(place)
            shape.append(("U" if c != low else "u") + str(block))
        else:
            shape.append(c)
    if not radices:
        return local
    fmt = "mail" + "".join(x.lower() for x in shape) + "@" + host.lower()
    new = iter(_mixed(f, digits, radices, fmt, back))
    out = []
    for x in shape:
        if len(x) == 2:
            letter = _ALPHABETS[int(x[1])][next(new)]
            out.append(letter.upper() if x[0] == "U" else letter)
        elif x in "Aa":
            out.append(chr((65 if x == "A" else 97) + next(new)))
        else:
            out.append(str(next(new)) if x == "9" else x)
    return "".join(out)


_BY_KIND: dict[str, Callable[[Feistel, str, bool], str | None]] = {
    "iban": _iban, "iso": _date("ymd", "-"), "dmy": _date("dmy", "."), "mdy": _date("mdy", "/"),
    "ymd": _date("ymd", "/"), "dash": _date("dmy", "-"), "ip6": _ip6, "ip": _ip, "ssn": _ssn, "nanp": _nanp, "phone": _phone, "card": _card,
}


class Pseudonyms:
    """Replaces the values of texts, with one key."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self._value = lru_cache(REMEMBERED)(lambda kind, s: _BY_KIND[kind](feistel, s, back))
        self._mail = lru_cache(REMEMBERED)(lambda local, host: _email(feistel, local, host, back))

    def replace(self, text: str) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        found: Counter = Counter()
        if not _ANY.search(text):
            return text, found
        if "@" in text:
            text = self._mails(text, found)

        parts, done = [], 0
        start = _START.search(text)
        while start:
            at = start.start()
            for kind, shape in _SHAPES:
                m = shape.match(text, at)
                runs = [] if not m else _iban_runs(m[0]) if kind == "iban" else [m[0]]
                if new := next((v for r in runs if (v := self._value(kind, r)) is not None), None):
                    parts += [text[done:at], new]
                    done = at = at + len(new)
                    found[_NAMES.get(kind, kind)] += 1
                    break
            start = _START.search(text, max(at, start.end()))
        return "".join([*parts, text[done:]]), found

    def _mails(self, text: str, found: Counter) -> str:
        parts, done, at = [], 0, text.find("@")
        while at >= 0:
            host = _EMAIL_HOST.match(text, at + 1)
            begin = at
            while host and begin > done and (text[begin - 1] in _EMAIL_LOCAL or _MORE_LETTER.match(text[begin - 1])):
                begin -= 1
            local_text = text[begin:at].lstrip(".%+-")
            if host and local_text:
                parts += [text[done : at - len(local_text)], self._mail(local_text, host[0].lower())]
                done = at
                found["email"] += 1
            at = text.find("@", at + 1)
        return "".join([*parts, text[done:]])


_drawn: list[bytes] = []


def secret_key() -> bytes:
    """The key of ``CARTOLITH_PII_KEY``, else one that this process draws and tells no one."""
    if told := os.environ.get("CARTOLITH_PII_KEY"):
        return told.encode()
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
        log.warning("CARTOLITH_PII_KEY is not set: pseudonyms of this run can't be undone or linked with other runs")
    return _drawn[0]


_made: dict[tuple[bytes, bool], Pseudonyms] = {}


def pseudonyms(key: bytes, back: bool = False) -> Pseudonyms:
    if (key, back) not in _made:
        _made[key, back] = Pseudonyms(key, back)
    return _made[key, back]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counts: bool = False, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``.

    With ``counts`` come ``n_values`` (long) and ``kinds`` (string like ``card:1,email:2``); columns
    of these names are replaced.
    """
    prepare(docs.sparkSession)
    if counts:
        docs = docs.drop("n_values", "kinds")
    at = docs.columns.index(text)

    def change(batch: pa.RecordBatch) -> list[pa.Array]:
        by = pseudonyms(key, back)
        got = [(None, Counter()) if t is None else by.replace(t) for t in batch.column(at).to_pylist()]
        cols = list(batch.columns)
        cols[at] = pa.array([t for t, _ in got], pa.string())
        if counts:
            cols.append(pa.array([sum(c.values()) for _, c in got], pa.int64()))
            cols.append(pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for _, c in got], pa.string()))
        return cols

    more = T.StructType().add("n_values", T.LongType()).add("kinds", T.StringType())
    return map_rows(docs, change, more if counts else None)
