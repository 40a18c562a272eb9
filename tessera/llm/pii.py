"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Validated values (card numbers by Luhn's check, IBANs by theirs, social security numbers, phone numbers,
IPv4 addresses, dates of the calendar, e-mail addresses) are mapped within their own format: a value is a
number below the count of values of its format, a Feistel network over the next even number of bits permutes
it, and results beyond the count go through it again (cycle walking). Check digits are made anew, separators
and letter cases stay. As each mapping is a bijection under one key, equal values stay equal in all documents
and different ones different; who has the key can map back. A date is mapped as a day, whatever its form; days up
to the 12th of a month and later ones are mapped among themselves, as dd/mm and mm/dd can be told apart for later ones only. What fails its validation stays as it is. IBANs and
phone numbers are mapped without their separators, phone numbers by country code and national number; those of
ten digits without a code (ddd ddd dddd and the like) count as of code 1, other national forms aren't known.

Rows: a null text stays null, an empty one empty. Rows are handled one by one, so repeated rows and ties give
equal results and empty tables empty ones. Texts are scanned whole. Input columns named as results are
replaced; others pass through. Offsets are code points of the input text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import from_text

ROUNDS = 8
#: Days that dates are mapped among.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ALPHABETS = [string.digits, string.ascii_lowercase, string.ascii_uppercase, ACCENTED, ACCENTED[:-1].upper()]
PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|([ -])[A-Z0-9]{4}(?:\1[A-Z0-9]{4}){1,6}(?:\1[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,4}){2,6}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
}
#: What follows the @ of an e-mail address, and what may stand before it beside letters and digits; its last character is a letter, digit or _.
HOST, LOCAL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), "_.+%-"
#: Longest parts before and after the @ of a valid address.
MAX_LOCAL, MAX_HOST = 64, 253
KINDS = ("email", *PATTERNS)
LIKELY = re.compile("[0-9@]")
#: Country codes of one and two digits; all others have three. Digits of a number with its code, and of an IBAN, at least.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
PHONE_DIGITS, IBAN_LEAST = (8, 15), 15
#: The last group of a value that stands in groups.
GROUPED = {"iban": re.compile("[ -][A-Z0-9]+$"), "phone": re.compile("[ .-][0-9]+$")}


class Feistel:
    """Keyed permutations of range(n), one for each name and n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _half(self, name: str, r: int, x: int, bits: int) -> int:
        digest = hashlib.blake2b(f"{name}:{r}:{bits}:{x}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, name: str, x: int, bits: int, back: bool) -> int:
        left, right, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._half(name, r, left, bits) & mask, left
            else:
                left, right = right, left ^ self._half(name, r, right, bits) & mask
        return left << bits | right

    def permute(self, name: str, x: int, n: int, good: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of x; walks on while it is beyond n or not good (x must be both)."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(name, x, bits, back)
            if x < n and good(x):
                return x


def luhn(digits: str) -> int:
    """Sum of Luhn's check, modulo 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _characters(f: Feistel, name: str, text: str, back: bool) -> str:
    """Every character that an alphabet holds changes within it; others stay. One mixed-radix number."""
    alphabets = [next((a for a in ALPHABETS if c in a), None) for c in text]
    x, n = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    shape = "".join(str(ALPHABETS.index(a)) if a else c for c, a in zip(text, alphabets, strict=True))
    y, out = f.permute(f"{name}:{shape}", x, n, back=back) if n > 1 else 0, []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            y, i = divmod(y, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    """The digits in the places of text's digits."""
    rest = iter(digits)
    return "".join(next(rest) if c in string.digits else c for c in text)


def _ssn(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of e-mail addresses: from each @ back to what can't be part of one, so each character is read once."""
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and at - start <= MAX_LOCAL and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
            start -= 1
        valid = 0 < at - start <= MAX_LOCAL and (text[at - 1].isalnum() or text[at - 1] == "_")
        m = HOST.match(text, at + 1, at + 2 + MAX_HOST) if valid else None
        before = m.end() if m else at + 1
        if m and m.end() - at - 1 <= MAX_HOST:
            yield start, m.end()
        at = text.find("@", before)


def _day(text: str) -> date | None:
    parts = [int(p) for p in re.split("[./-]", text)]
    y, m, d = parts if len(text.split("-")[0]) == 4 else (parts[2], parts[1], parts[0])
    for month, day in ((m, d), (d, m)):  # day first, else month first
        try:
            found = date(y, month, day)
        except ValueError:
            continue
        return found if FIRST_DAY <= found <= LAST_DAY else None
    return None


def pseudonym(f: Feistel, kind: str, text: str, back: bool = False) -> str | None:
    """What a matched value becomes, or None if it isn't valid. back maps a pseudonym to its value."""
    digits = "".join(c for c in text if c in string.digits)
    if kind == "email":
        name, _, host = text.rpartition("@")
        labels = host.split(".")
        keep = min(2, len(labels) - 1)  # the registered domain stays, what stands before it doesn't
        inner, outer = ".".join(labels[:-keep]), ".".join(labels[-keep:])
        return _characters(f, f"email:{outer}", f"{name}@{inner}", back) + ("." if inner else "") + outer
    if kind == "iban":
        whole = re.sub("[ -]", "", text)
        if len(whole) < IBAN_LEAST or int(whole[2:4]) != iban_check(whole[:2], whole[4:]):
            return None
        rest = _characters(f, f"iban:{whole[:2]}", whole[4:], back)
        new = iter(f"{whole[:2]}{iban_check(whole[:2], rest):02d}{rest}")
        return "".join(c if c in " -" else next(new) for c in text)
    if kind == "card":
        if luhn(digits) or not int(digits):
            return None
        n = len(digits) - 2
        inner = f"{digits[0]}{f.permute(f'card:{digits[0]}:{n}', int(digits[1:-1]), 10**n, back=back):0{n}d}"
        return _refill(text, inner + str(-luhn(inner + "0") % 10))
    if kind == "ssn":
        return _refill(text, f"{f.permute('ssn', int(digits), 10**9, _ssn, back):09d}") if _ssn(int(digits)) else None
    if kind == "ip":
        octets = [int(p) for p in text.split(".")]
        if max(octets) > 255:
            return None
        x = f.permute("ip", int.from_bytes(bytes(octets), "big"), 1 << 32, back=back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        day = _day(text)
        if day is None:
            return None
        days = (LAST_DAY - FIRST_DAY).days + 1
        # days beyond the 12th stay so: what is written month first can't be read day first before or after
        late = day.day > 12
        new = FIRST_DAY + timedelta(f.permute("date", (day - FIRST_DAY).days, days, lambda x: ((FIRST_DAY + timedelta(x)).day > 12) == late, back))
        if text[4] == "-":
            return new.isoformat()
        month_first = int(text[3:5]) > 12
        return f"{new.month:02d}{text[2]}{new.day:02d}{text[5]}{new.year}" if month_first else f"{new.day:02d}{text[2]}{new.month:02d}{text[5]}{new.year}"
    if "(0)" in text:  # the trunk digit, which isn't dialled after a code
        head, tail = text.split("(0)", 1)
        new = pseudonym(f, kind, head + tail, back)
        return None if new is None else f"{new[: len(head)]}(0){new[len(head) :]}"
    if text[0] == "+" and not PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
        return None
    lead = next((n for n in (1, 2) if digits[:n] in CODES), 3) if text[0] == "+" else 0
    inner = digits[lead:]
    code = digits[:lead] or "1"
    return _refill(text, digits[:lead] + f"{f.permute(f'phone:{code}:{len(inner)}', int(inner), 10 ** len(inner), back=back):0{len(inner)}d}")


def replace(f: Feistel, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans (start, end, kind) of what they replaced."""
    if not LIKELY.search(text):
        return text, []
    found = []
    for start, end in emails(text):
        found.append((start, end, "email", pseudonym(f, "email", text[start:end], back)))
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            value = m[0]
            while (new := pseudonym(f, kind, value, back)) is None and kind in GROUPED and (last := GROUPED[kind].search(value)):
                value = value[: last.start()]  # the last group may belong to what follows
            if new is not None:
                found.append((m.start(), m.start() + len(value), kind, new))
    order = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda x: (x[0], -x[1], order[x[2]]))
    parts, spans, at = [], [], 0
    for start, end, kind, new in found:
        if start >= at:
            parts += [text[at:start], new]
            spans.append((start, end, kind))
            at = end
    return "".join([*parts, text[at:]]), spans


def pseudonymize(df: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of df, text with pseudonyms, and pii_spans (start, end, kind)."""
    f = Feistel(key)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (text, "pii_spans")]
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    fields = T.StructType([T.StructField("new", T.StringType()), T.StructField("spans", T.ArrayType(place))])

    def compute(t: str) -> tuple:
        new, spans = replace(f, t)
        return new, [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).isNull().alias("none"), F.col(text).alias("text"))
    made = from_text(rows, "text", ["row", "none"], compute, fields)
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.when(~F.col("none"), F.col("new")).alias(text), F.col("spans").alias("pii_spans"))
