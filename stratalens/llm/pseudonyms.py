"""Format-preserving pseudonyms: a keyed Feistel permutation per kind of value.

Each detector validates what it finds (Luhn and mod-97 check digits, calendar dates, octet ranges,
number plans), maps the value to an integer below the size of its format, permutes that integer with
a keyed Feistel network (walking the cycle until the result is in range again) and writes it back in
the same format, check digits renewed.  The permutation depends on the kind and the canonical value
only, so equal values stay linked across documents, and different values stay different.  The canonical
value leaves out the case of ASCII letters in e-mail addresses and of hexadecimal digits, and how digits
are grouped.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import ship_package

_ROUNDS = 8
_EPOCH = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2100, 1, 1).toordinal() - _EPOCH


def secret(key: bytes) -> bytes:
    """The 32-byte key of the permutations; a key of any length but 0 will do."""
    if not key:
        raise ValueError("the key must not be empty")
    return hashlib.blake2b(key, digest_size=32, person=b"stratalens-pii").digest()


def _stream(message: bytes, key: bytes, width: int) -> bytes:
    """``width`` pseudorandom bytes of a message: keyed hashes in counter mode."""
    if width > 64:  # many blocks come from one hash of the message, so that they cost as much as it is long
        message = hashlib.blake2b(message, key=key, digest_size=64).digest()
    parts = (hashlib.blake2b(i.to_bytes(4, "big") + message, key=key, digest_size=64).digest() for i in range(-(-width // 64)))
    return b"".join(parts)[:width]


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 <= value < size, of any size."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8 + 8
    salt = tweak.encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(_ROUNDS):
            h = _stream(bytes([r]) + right.to_bytes(width, "big") + salt, key, width)
            left, right = right, left ^ (int.from_bytes(h, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _number(digits: str, key: bytes, kind: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}")).zfill(len(digits))


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = _number(d[:-1], key, "card")
    return _refill(s, body + luhn_digit(body))


#: Fixed values of the North American number plan: area codes and exchanges are 200 to 999 but those that
#: end in 11; the middle digit of an area code is not 9.
_AREAS = [n for n in range(200, 1000) if n % 100 != 11 and n // 10 % 10 != 9]
_EXCHANGES = [n for n in range(200, 1000) if n % 100 != 11]
_AREA_AT, _EXCHANGE_AT = ({n: i for i, n in enumerate(v)} for v in (_AREAS, _EXCHANGES))


def _plan_number(digits: str) -> int | None:
    """The place of a ten-digit number among those of the plan."""
    area, exchange = _AREA_AT.get(int(digits[:3])), _EXCHANGE_AT.get(int(digits[3:6]))
    return None if area is None or exchange is None else (area * len(_EXCHANGES) + exchange) * 10_000 + int(digits[6:])


def _phone(s: str, key: bytes) -> str | None:
    """Numbers of the North American plan stay in it, others (of other plans) stay outside; country codes stay."""
    d = _digits(s)
    if not 10 <= len(d) <= 15 or (s[0] == "+" and d[0] == "0"):
        return None
    n = _plan_number(d[-10:])
    if n is None:
        new = _number(d[-10:], key, "phone")
        while _plan_number(new) is not None:  # the cycle leads back outside
            new = _number(new, key, "phone")
    else:
        n, line = divmod(permute(n, len(_AREAS) * len(_EXCHANGES) * 10_000, key, "plan"), 10_000)
        new = f"{_AREAS[n // len(_EXCHANGES)]}{_EXCHANGES[n % len(_EXCHANGES)]}{line:04d}"
    return _refill(s, d[:-10] + new)


def _ssn(s: str, key: bytes) -> str | None:
    d = _digits(s)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = area - 1 - (area > 666)
    n = permute((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    area += 1 + (area + 1 >= 666)
    return _refill(s, f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _ipv4(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(year: int, month: int, day: int, key: bytes) -> dt.date | None:
    try:
        n = dt.date(year, month, day).toordinal() - _EPOCH
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    return dt.date.fromordinal(_EPOCH + permute(n, _DAYS, key, "date"))


def _iso(s: str, key: bytes) -> str | None:
    d = _date(int(s[:4]), int(s[5:7]), int(s[8:]), key)
    return d and f"{d.year:04d}{s[4]}{d.month:02d}{s[4]}{d.day:02d}"


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """The dates after the 12th of a month, as numbers."""
    return [n for n in range(_DAYS) if dt.date.fromordinal(_EPOCH + n).day > 12]


def _day_first(s: str, key: bytes) -> str | None:
    """dd.mm.yyyy or dd/mm/yyyy; where that is no date, mm/dd/yyyy.

    The latter are permuted among themselves, the dates that cannot be read with the day first, and are
    not linked with the same dates in other layouts.
    """
    a, b, year = int(s[:2]), int(s[3:5]), int(s[6:])
    if d := _date(year, b, a, key):
        return f"{d.day:02d}{s[2]}{d.month:02d}{s[2]}{d.year:04d}"
    if b <= 12 or not _date(year, a, b, key):
        return None
    late = _late_days()
    at = bisect_left(late, dt.date(year, a, b).toordinal() - _EPOCH)
    d = dt.date.fromordinal(_EPOCH + late[permute(at, len(late), key, "month first")])
    return f"{d.month:02d}{s[2]}{d.day:02d}{s[2]}{d.year:04d}"


@lru_cache(maxsize=1024)
def _alphabet(page: int, category: str) -> str:
    """The characters of one category in a page of 256 code points that are not ASCII."""
    return "".join(c for c in map(chr, range(max(page * 256, 128), page * 256 + 256)) if unicodedata.category(c) == category)


def _class(c: str) -> tuple[str, str]:
    """A name and the alphabet in which a character is permuted; one that stays has an alphabet of its own."""
    if "0" <= c <= "9":
        return "0", "0123456789"
    if c.isascii():
        return ("a", "abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z" else ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if "A" <= c <= "Z" else (c, c)
    category = unicodedata.category(c)
    return (f"<{ord(c) // 256}{category}>", _alphabet(ord(c) // 256, category)) if c.isalnum() else (c, c)


#: Longer strings are permuted half by half, digit by digit, instead of as one number.
_LONG_MIXED = 512


def _halves(digits: list[int], bases: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A Feistel network on the two halves of a string: each round adds to one half, modulo its bases, what the other one makes."""
    d, b = np.array(digits, dtype=np.int64), np.array(bases, dtype=np.int64)
    cut = len(d) // 2
    sides = (slice(0, cut), slice(cut, len(d)))
    for r in range(_ROUNDS):
        to, of = sides[r % 2], sides[1 - r % 2]
        made = _stream(bytes([r]) + d[of].astype("<u4").tobytes() + tweak, key, 4 * (to.stop - to.start))
        d[to] = (d[to] + np.frombuffer(made, dtype="<u4")) % b[to]
    return d.tolist()


def _mixed(chars: str, key: bytes, kind: str) -> str:
    """Permute the letters and digits of a string within their classes; other characters stay."""
    classes = [_class(c) for c in chars]
    if len(chars) > _LONG_MIXED:
        tweak = (kind + "".join(name for name, _ in classes)).encode()
        digits = _halves([alphabet.index(c) for c, (_, alphabet) in zip(chars, classes, strict=True)], [len(alphabet) for _, alphabet in classes], key, hashlib.blake2b(tweak, key=key, digest_size=32).digest())
        return "".join(alphabet[at] for at, (_, alphabet) in zip(digits, classes, strict=True))
    value, size = 0, 1
    for c, (_, alphabet) in zip(chars, classes, strict=True):
        value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    value, out = permute(value, size, key, kind + "".join(name for name, _ in classes)), []
    for _, alphabet in reversed(classes):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def _iban_check(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _iban(s: str, key: bytes) -> str | None:
    t = s.replace(" ", "")
    country, body = t[:2], t[4:]
    if not 15 <= len(t) <= 34 or _iban_check(country, body) != t[2:4]:
        return None
    body = _mixed(body, key, "iban" + country)
    it = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(it) for c in s)


def _hex(s: str, key: bytes) -> str | None:
    """Long hexadecimal secrets.  Mixed case is read as one value and written in lower case."""
    if len(set(s.lower())) < 6 or not _ANY_DIGIT.search(s):
        return None
    out = f"{permute(int(s, 16), 16 ** len(s), key, f'hex{len(s)}'):0{len(s)}x}"
    return out.upper() if s == s.upper() else out


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    low = "".join(c.lower() if c.isascii() else c for c in local)
    out = _mixed(low, key, "email" + domain.lower())
    return "".join(o.upper() if c.isascii() and c.isupper() else o for o, c in zip(out, local, strict=True)) + "@" + domain


#: kind, pattern (verbose groups are tried from left to right at each place), how its value is permuted.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("hex", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])", _hex),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("ipv4", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", _ipv4),
    ("date_iso", r"(?<![0-9A-Za-z])(?:19|20)[0-9]{2}([-/.])[0-9]{2}\GROUP[0-9]{2}(?![0-9A-Za-z])", _iso),
    ("date_day", r"(?<![0-9A-Za-z])[0-9]{2}([-/.])[0-9]{2}\GROUP(?:19|20)[0-9]{2}(?![0-9A-Za-z])", _day_first),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])", _ssn),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", _card),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{10,15}(?![0-9A-Za-z])", _phone),
)
_EMAIL = re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY_DIGIT = re.compile(r"[0-9]")


def _compile() -> re.Pattern:
    """One pattern with a group per kind; the group numbers that the date kinds refer to are set here."""
    parts, group = [], 0
    for kind, pattern, _ in KINDS:
        group += 1
        if "([-/.])" in pattern:
            group += 1
            pattern = pattern.replace(r"\GROUP", rf"\{group}")
        parts.append(f"(?P<{kind}>{pattern})")
    return re.compile("|".join(parts))


_FIND = _compile()
_MAKE = {kind: f for kind, _, f in KINDS}
_EACH = {kind: re.compile(pattern.replace(r"\GROUP", r"\1")) for kind, pattern, _ in KINDS}
#: Kinds whose pattern runs over blanks or hyphens into what stands next to the value.
_LOOSE = ("iban", "card")
#: How cards are written: in one run, or in the groups of 13 to 19 digit numbers.
_CARD_SHAPE = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{1,4}|[0-9]{4}\1[0-9]{1,3})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")


def _made(kind: str, value: str, key: bytes) -> str | None:
    return _email(value, key) if kind == "email" else _MAKE[kind](value, key)


_kept = lru_cache(maxsize=65536)(_made)
#: Longer values are made anew each time, so that the cache holds 17 MB of them at most.
_LONGEST_KEPT = 128


def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    return _kept(kind, value, key) if len(value) <= _LONGEST_KEPT else _made(kind, value, key)


def _ends(kind: str, text: str, m: re.Match, stop: int) -> list[int]:
    """Where a value of ``kind`` that starts with ``m`` can end, at ``stop`` at most; longest first, usual card shapes before others."""
    ends = [m.end()]
    if kind in _LOOSE:
        ends += [e for e in range(m.end() - 1, m.start(), -1) if text[e] in " -" and _EACH[kind].fullmatch(text, m.start(), e)]
    ends = [e for e in ends if e <= stop]
    return sorted(ends, key=lambda e: not _CARD_SHAPE.fullmatch(text, m.start(), e)) if kind == "card" else ends


def _value(text: str, start: int, stop: int, key: bytes, usual: bool = False) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the value at ``start``: every kind, and every end of it, until one is valid.

    A card in an unusual shape (digits of two neighbours can pass Luhn by chance) gives way to any other
    value that starts in it, and is left out if ``usual``.
    """
    odd = None
    for kind, _, _ in KINDS:
        if not (m := _EACH[kind].match(text, start)):
            continue
        for end in _ends(kind, text, m, stop):
            if (new := _pseudonym(kind, text[start:end], key)) is None:
                continue
            if kind != "card" or _CARD_SHAPE.fullmatch(text, start, end):
                return kind, end, new
            odd = odd or (kind, end, new)
    if odd is None or usual:
        return None
    at = start + 1
    while (m := _FIND.search(text, at)) and m.start() < odd[1]:
        if _value(text, m.start(), stop, key, usual=True):
            return None
        at = m.start() + 1
    return odd


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind.

    Where a match fails its validation, the other kinds and the shorter ends at group borders are tried
    at the same place; then the search goes on from the next character, so that a value inside it (say a
    date in a longer run) is still found.  A value ends before an e-mail address that follows it.
    """
    return _pseudonymise(text, secret(key))


def _pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    counts: dict[str, int] = {}
    out: list[str] = []
    last = 0
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        for m in _emails(text):
            new = _pseudonym("email", m[0], key)
            spans.append((m.start(), m.end(), new))
            counts["email"] = counts.get("email", 0) + 1
    if _ANY_DIGIT.search(text):  # every kind holds a digit
        taken, at, pos = spans, 0, 0
        found: list[tuple[int, int, str]] = []
        while m := _FIND.search(text, pos):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            stop = taken[at][0] if at < len(taken) else len(text)
            if stop <= m.start():
                pos = taken[at][1]
                continue
            value = _value(text, m.start(), stop, key)
            if value is None:
                pos = m.start() + 1
                continue
            kind, end, new = value
            found.append((m.start(), end, new))
            kind = kind.partition("_")[0]
            counts[kind] = counts.get(kind, 0) + 1
            pos = end
        spans = sorted(taken + found)
    for start, end, new in spans:
        out += (text[last:start], new)
        last = end
    return ("".join(out) + text[last:], counts) if spans else (text, counts)


def _emails(text: str) -> Iterator[re.Match]:
    """E-mail matches found from their at signs, so that text without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isalnum() or text[begin - 1] in "_.%+-"):
            begin -= 1
        if m := _EMAIL.match(text, begin):
            yield m
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if ``docs`` has such a column already."""
    while name in docs.columns:
        name += "_"
    return name


def pseudonymise_documents(docs: DataFrame, key: bytes, text: str = "text", kinds: str = "pii_kinds") -> DataFrame:
    """All columns of ``docs``, ``text`` pseudonymised, plus ``kinds`` (such as "card:2,email:1"; empty if none).

    A null text stays null with empty kinds.  Rows and their order in a partition do not change; no rows
    give no rows.  Where ``docs`` has a column named like ``kinds``, the new one gets underscores behind its name.
    """
    ship_package(docs.sparkSession)
    name, own_key = free_name(docs, kinds), secret(key)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text)
            done = [(None, {}) if t is None else _pseudonymise(t, own_key) for t in b.column(k).to_pylist()]
            told = [",".join(f"{x}:{n}" for x, n in sorted(c.items())) for _, c in done]
            cols = [pa.array([t for t, _ in done], pa.string()) if i == k else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(told, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
