"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation (check digits, calendar, ranges), and addresses and secrets made of letters and digits, are
permuted within their format by a keyed Feistel network: letters stay letters, digits digits, separators where they are, and a
valid number gives a valid number, by permuting again until it is one. Separators play no part in what becomes of digits and letters: the
same value gives the same pseudonym in every document, however it is written, and different values of a kind different ones; the key's
holder can invert it.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Longer runs are permuted in parts.
PART = 64
#: Descriptions of longer formats are named by a digest, and pseudonyms of longer values aren't kept.
MOST_FORMAT, MOST_KEPT = 4096, 256


def _mix(key: bytes, tweak: bytes, r: int, x: int) -> int:
    """key has at most 64 bytes; see short_key."""
    return int.from_bytes(hashlib.blake2b(x.to_bytes(64, "big") + tweak, key=key, digest_size=64, salt=bytes([r])).digest(), "big")


def short_key(key: bytes) -> bytes:
    """A key of any length as one that the hash takes."""
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def permute(x: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over the bits of size - 1, walked until it ends inside."""
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    b = bits // 2
    a = bits - b
    while True:
        if not inverse:
            left, right, n, m = x >> b, x & (1 << b) - 1, a, b
            for r in range(ROUNDS):
                left, right = right, left ^ (_mix(key, tweak, r, right) & (1 << n) - 1)
                n, m = m, n
        else:
            left, right, n, m = x >> b, x & (1 << b) - 1, a, b
            for r in reversed(range(ROUNDS)):
                n, m = m, n
                left, right = right ^ (_mix(key, tweak, r, left) & (1 << n) - 1), left
        x = left << b | right
        if x < size:
            return x


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _alphabets(text: str, hexadecimal: bool) -> list[str]:
    if hexadecimal:
        low = text == text.lower()
        return [(_HEX if low else _HEX.upper()) if c in "0123456789abcdefABCDEF" else c for c in text]
    return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else c for c in text]


def permute_text(text: str, key: bytes, tweak: bytes, *, hexadecimal: bool = False, keep: int = 0, valid=None, inverse: bool = False) -> str:
    """Permutes a text's digits and letters within their alphabets, after the first `keep` of them, until valid(text) holds.

    valid must hold of the text itself; texts of more than PART such characters are permuted in parts, without valid.
    """
    alphabets = _alphabets(text, hexadecimal)
    spots = [i for i, a in enumerate(alphabets) if len(a) > 1][keep:]
    chars = list(text)
    form = "".join(a if len(a) == 1 else str(len(a)) + a[0] for a in alphabets).encode()
    if len(form) > MOST_FORMAT:
        form = hashlib.blake2b(form).digest()
    for at in range(0, len(spots), PART):
        part = spots[at : at + PART]
        size = 1
        for i in part:
            size *= len(alphabets[i])
        shape = b"|".join((tweak, form, str(at).encode()))
        x = 0
        for i in part:
            x = x * len(alphabets[i]) + alphabets[i].index(chars[i])
        while True:
            x = permute(x, size, key, shape, inverse)
            y = x
            for i in reversed(part):
                y, d = divmod(y, len(alphabets[i]))
                chars[i] = alphabets[i][d]
            if valid is None or len(spots) > PART or valid("".join(chars)):
                break
    return "".join(chars)


def luhn(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def ipv4(text: str) -> bool:
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split("."))


def ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def phone(text: str) -> bool:
    return 7 <= sum(c.isdigit() for c in text) <= 15


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_DATE = {"iso": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}


def _read_date(text: str) -> tuple[str, datetime.date] | None:
    parts = [int(p) for p in re.split(r"[-/.]", text)]
    for style in ("iso",) if len(re.split(r"[-/.]", text)[0]) == 4 else ("dmy", "mdy"):
        y, m, d = (parts[i] for i in _DATE[style])
        if 1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= 31:
            try:
                return style, datetime.date(y, m, d)
            except ValueError:
                continue
    return None


def permute_date(text: str, key: bytes, inverse: bool = False) -> str:
    """Another day of 1900 to 2099 in the text's own style, which reads the same way. A day of the month up to 12 stays one, and a later
    one too, so that a day has one pseudonym in all styles and no style mistakes it for another day."""
    style, day = _read_date(text)
    sep, late = next(c for c in text if c in "-/."), day.day > 12
    x = day.toordinal() - _FIRST
    while True:
        x = permute(x, _DAYS, key, b"date", inverse)
        day = datetime.date.fromordinal(_FIRST + x)
        if (day.day > 12) == late:
            break
    values = {0: f"{day.year:04d}", 1: f"{day.month:02d}", 2: f"{day.day:02d}"}
    return sep.join(values[i] for i in {"iso": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (1, 2, 0)}[style])


_EDGE = r"(?<![0-9A-Za-z]){}(?![0-9A-Za-z])"
#: Kinds of several groups of characters, which may stand beside further numbers or capital words.
GROUPED = ("iban", "card", "phone")
#: Kinds in the order in which they claim a span: name, what a text must hold for it, pattern, validation. Numbers that fail theirs stay.
KINDS = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"), None),
    ("iban", "", re.compile(_EDGE.format(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")), iban),
    ("date", "", re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])"), lambda t: _read_date(t) is not None),
    ("ipv4", ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), ipv4),
    ("card", "", re.compile(_EDGE.format(r"[0-9](?:[ -]?[0-9]){12,18}")), luhn),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"), ssn),
    ("phone", "", re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|\([0-9]{2,4}\)|[0-9]{3}(?=[ .-][0-9]{3}[ .-][0-9]{4}))(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"), phone),
    ("secret", "", re.compile(_EDGE.format(r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{20,}") + "|" + _EDGE.format(r"(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{20,}")), None),
)


#: Country calling codes of one and of two digits; all others have three.
CALLING_CODES = (
    "1", "7",
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def _country(digits: str) -> int:
    """How many digits of an international number its country code has; at least six others stay to be permuted."""
    n = next((k for k in (1, 2) if digits[:k] in CALLING_CODES), 3)
    return max(0, min(n, len(digits) - 6))


def _refilled(value: str, bare: str) -> str:
    """The value with its letters and digits, from left to right, replaced by those of bare."""
    chars = iter(bare)
    return "".join(next(chars) if c.isascii() and c.isalnum() else c for c in value)


@functools.lru_cache(maxsize=30_000)
def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str:
    """A value's pseudonym of the same format, or with inverse the value of a pseudonym.

    An address keeps its domain's last part, a card its first digit, a phone number with a + its country code, an IBAN its country. Values
    that differ in separators alone have pseudonyms that differ in them alone.
    """
    key, tweak = short_key(key), kind.encode()
    bare = "".join(c for c in value if c.isascii() and c.isalnum())
    if kind == "date":
        return permute_date(value, key, inverse)
    if kind == "email":
        at = value.rindex(".")
        return permute_text(value[:at], key, tweak, inverse=inverse) + value[at:]
    if kind in ("ipv4", "ssn"):
        return permute_text(value, key, tweak, valid={"ipv4": ipv4, "ssn": ssn}[kind], inverse=inverse)
    if kind == "secret":
        out = permute_text(bare.lower(), key, tweak, hexadecimal=True, inverse=inverse)
        return out if value == value.lower() else out.upper()
    if kind == "iban":
        head, rest = bare[:2], permute_text(bare[4:], key, tweak + bare[:2].encode(), inverse=inverse)
        number = int("".join(str(int(c, 36)) for c in rest + head + "00"))
        return _refilled(value, f"{head}{98 - number % 97:02d}{rest}")
    if kind == "card":
        return _refilled(value, permute_text(bare, key, tweak, keep=1, valid=luhn, inverse=inverse))
    if value[0] == "+":
        return _refilled(value, permute_text(bare, key, tweak + b"+", keep=_country(bare), inverse=inverse))
    return _refilled(value, permute_text(bare, key, tweak, inverse=inverse))


def _spans(text: str, kind: str, pattern: re.Pattern, valid, free) -> list[tuple[int, int, str]]:
    """The spans of a kind, apart and from left to right, that pass their validation and are free.

    Of the spans of groups that begin at one place the longest that passes is taken; if none does, the next place is tried.
    """
    out, at = [], 0
    while m := pattern.search(text, at):
        a, b = m.span()
        at = b
        ends = [b]
        if kind in GROUPED:
            at = a + 1
            ends += [e for e in range(b - 1, a, -1) if not (text[e].isascii() and text[e].isalnum())]
        for e in ends:
            if (e == b or pattern.fullmatch(text, a, e)) and (valid is None or valid(text[a:e])) and free(a, e):
                out.append((a, e, kind))
                at = e
                break
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is replaced, in order and apart."""
    taken: list[tuple[int, int, str]] = []
    for kind, sign, pattern, valid in KINDS:
        if sign and sign not in text:
            continue
        starts = [x for x, *_ in taken]

        def free(a, b, taken=taken, starts=starts):
            # What is taken is apart: only the last that begins before b can reach into a span.
            i = bisect.bisect_left(starts, b)
            return not i or taken[i - 1][1] <= a

        taken = sorted(taken + _spans(text, kind, pattern, valid, free))
    return taken


def replace(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, of the same length, and the kinds found."""
    if not text or not re.search("[0-9@]", text):
        return text, []
    found, out, at = find(text), [], 0
    for a, b, kind in found:
        out += [text[at:a], (pseudonym if b - a <= MOST_KEPT else pseudonym.__wrapped__)(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), [k for _, _, k in found]


def pseudonymised(text: Column, key: bytes) -> Column:
    """A struct of the text with pseudonyms (null for null), how many there are, and their kinds, sorted and comma-joined."""

    @F.pandas_udf("text string, n_found long, kinds string")
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [replace(t, key) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in got], "n_found": [len(k) for _, k in got], "kinds": [",".join(sorted(set(k))) for _, k in got]})

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """The rows with all their columns, the text column's personal data replaced.

    Null and empty texts stay as they are; texts of any length are searched whole, in time that grows with their length; equal values give
    equal pseudonyms everywhere, so repeated rows stay repeated. An empty table gives an empty one; other columns, whatever their names,
    stay as they are.
    """
    return docs.withColumn(text_col, pseudonymised(F.col(text_col), key)["text"])
