"""Pseudonyms for personal numbers, dates and addresses that keep their format.

What passes validation (check digits, calendar, ranges) is numbered within all valid values of its
format and permuted there by a keyed Feistel network, walked until the result is valid again. The
same value gets the same pseudonym in every file, however it is punctuated, two values never share
one, and whoever holds the key can reverse it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.texts import per_text

ROUNDS = 8
KINDS = ("email", "iban", "address", "date", "ssn", "phone", "card")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1


def permute(value: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size); ``back`` is its inverse."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            known = left if back else right
            mixed = hashlib.blake2b(known.to_bytes(half // 8 + 1, "big") + bytes([step]), key=key, digest_size=64).digest()
            while 8 * len(mixed) < half:
                mixed += hashlib.blake2b(mixed, key=key, digest_size=64).digest()
            mixed = int.from_bytes(mixed, "big") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, valid: Callable[[int], bool], back: bool = False) -> int:
    """The same among the valid values of range(size) only."""
    while True:
        value = permute(value, size, key, back)
        if valid(value):
            return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 - k % 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order, punctuation kept."""
    fresh = iter(digits)
    return re.sub("[0-9]", lambda _: next(fresh), text)


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def card(text: str, key: bytes, back: bool) -> str | None:
    """13 to 19 digits by Luhn; the first digit stays, the check digit is made anew."""
    digits = only_digits(text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    size = len(digits) - 2
    body = digits[0] + f"{permute(int(digits[1:-1]), 10**size, key, back):0{size}d}"
    return refill(text, body + str(luhn(body)))


def phone(text: str, key: bytes, back: bool) -> str | None:
    """North American: area and exchange start with 2 to 9. Others keep their first two digits."""
    digits = only_digits(text)
    plain = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if text[0] != "+" or digits[0] == "1":
        valid = lambda n: f"{n:010d}"[0] > "1" and f"{n:010d}"[3] > "1"
        if len(plain) != 10 or not valid(int(plain)):
            return None
        fresh = walk(int(plain), 10**10, key, valid, back)
        return refill(text, digits[: len(digits) - 10] + f"{fresh:010d}")
    size = len(digits) - 2
    return refill(text, digits[:2] + f"{permute(int(digits[2:]), 10**size, key, back):0{size}d}")


def ssn(text: str, key: bytes, back: bool) -> str | None:
    """Area neither 000, 666 nor from 900 on, group not 00, serial not 0000."""

    def valid(n: int) -> bool:
        area, rest = divmod(n, 10**6)
        return 0 < area < 900 and area != 666 and rest // 10**4 > 0 and rest % 10**4 > 0

    number = int(only_digits(text))
    return refill(text, f"{walk(number, 10**9, key, valid, back):09d}") if valid(number) else None


def address(text: str, key: bytes, back: bool) -> str | None:
    """Dotted IPv4 of networks 1 to 223, but for 10 and 127."""
    parts = [int(part) for part in text.split(".")]
    if max(parts) > 255 or any(part != str(int(part)) for part in text.split(".")):
        return None
    valid = lambda n: 0 < n >> 24 < 224 and n >> 24 not in (10, 127)
    number = int.from_bytes(bytes(parts), "big")
    if not valid(number):
        return None
    return ".".join(map(str, walk(number, 1 << 32, key, valid, back).to_bytes(4, "big")))


def date(text: str, key: bytes, back: bool) -> str | None:
    """Days from 1900 to 2099: 2024-01-31, or day or month first with dots or slashes.

    Where either order is possible the day comes first; the order stays. A day or month of one
    digit keeps one digit.
    """
    parts = re.split("[-./]", text)
    a, b, c = map(int, parts)
    mark = re.search("[-./]", text)[0]
    orders = [(a, b, c)] if text[:4].isdigit() else [(c, b, a), (c, a, b)]
    for swapped, (year, month, day) in enumerate(orders):
        try:
            found = datetime.date(year, month, day)
        except ValueError:
            continue
        if FIRST_DAY <= found <= LAST_DAY:
            break
    else:
        return None

    def fields(n: int) -> list[int]:
        fresh = FIRST_DAY + datetime.timedelta(n)
        if text[:4].isdigit():
            return [fresh.year, fresh.month, fresh.day]
        return [fresh.month, fresh.day, fresh.year] if swapped else [fresh.day, fresh.month, fresh.year]

    def written(n: int) -> str:
        return mark.join(f"{x:0{len(part)}d}" for x, part in zip(fields(n), parts, strict=True))

    def valid(n: int) -> bool:  # month first only while the day shows it
        fits = all(x < 10 for x, part in zip(fields(n), parts, strict=True) if len(part) == 1)
        return fits and (not swapped or (FIRST_DAY + datetime.timedelta(n)).day > 12)

    return written(walk((found - FIRST_DAY).days, DAYS, key, valid, back))


def _remainder(country: str, checks: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + checks)) % 97


def iban(text: str, key: bytes, back: bool) -> str | None:
    """Country and letters stay, the digits of the account are permuted, the checks are made anew."""
    plain = text.replace(" ", "")
    country, checks, body = plain[:2], plain[2:4], plain[4:]
    digits = only_digits(body)
    if not digits or _remainder(country, checks, body) != 1:
        return None
    body = refill(body, f"{permute(int(digits), 10 ** len(digits), key, back):0{len(digits)}d}")
    fresh = iter(f"{country}{98 - _remainder(country, '00', body):02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in text)


def email(text: str, key: bytes, back: bool) -> str:
    """Letters and digits before the @ change within their kind; signs and the domain stay."""
    name, at, domain = text.partition("@")
    value, size = 0, 1
    for c in name:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value = value * base + (int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0)
        size *= base
    value = permute(value, size, key, back)
    out = []
    for c in reversed(name):
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, n = divmod(value, base)
        out.append(str(n) if base == 10 else c if base == 1 else chr(n + (65 if c.isupper() else 97)))
    return "".join(reversed(out)) + at + domain


EDGE = r"(?<![A-Za-z0-9])(?<![0-9][.,:/-])"
END = r"(?![A-Za-z0-9])(?![.,:/-][0-9])"
PATTERNS = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"), email),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), iban),
    "address": (re.compile(EDGE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + END), address),
    "date": (re.compile(EDGE + r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})" + END), date),
    "ssn": (re.compile(EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END), ssn),
    "phone": (
        re.compile(
            r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .(-]{0,2}[0-9]{2,4}(?:[ .)-]{0,2}[0-9]{2,4}){1,4}" + END
            + "|" + r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + END
            + "|" + EDGE + r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}" + END
        ),
        phone,
    ),
    "card": (re.compile(EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + END), card),
}
DIGIT = re.compile("[0-9]")
SEPARATOR = re.compile("[ -]")
#: Kinds whose patterns may run on into what follows, and the least characters of a value.
RUNNING = {"iban": 15, "card": 13}
#: Characters of an account number by country; others may have any length.
IBAN_LENGTHS = {
    length: countries.split()
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
IBAN_LENGTH = {country: length for length, countries in IBAN_LENGTHS.items() for country in countries}


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value that begins at ``start`` may end, the furthest first: ``end``, or a separator before it."""
    if kind not in RUNNING:
        return [end]
    ends = [end, *(m.start() for m in SEPARATOR.finditer(text, start, end))]
    sizes = {at: len(SEPARATOR.sub("", text[start:at])) for at in ends}
    wanted = IBAN_LENGTH.get(text[start : start + 2]) if kind == "iban" else None
    return sorted((at for at in ends if sizes[at] >= RUNNING[kind] and wanted in (None, sizes[at])), reverse=True)


def replacements(text: str, key: str, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) in order, without overlaps; a kind listed earlier goes first."""
    found: list[tuple[int, int, str, str]] = []
    if not DIGIT.search(text) and "@" not in text:
        return found
    for kind in KINDS:
        pattern, change = PATTERNS[kind]
        if kind == "email" and "@" not in text:
            continue
        secret = hashlib.blake2b(kind.encode(), key=key.encode()[:64], digest_size=32).digest()
        fresh = []
        match = pattern.search(text)
        while match:
            start, end = match.span()
            after = end
            if kind in RUNNING and (apart := SEPARATOR.search(text, start, end)):
                after = apart.end()  # what follows may be a value of its own
            for stop in _ends(kind, text, start, end):
                if _taken(found, start, stop):
                    continue
                pseudonym = change(text[start:stop], secret, back)
                if pseudonym is not None:
                    fresh.append((start, stop, kind, pseudonym))
                    after = stop
                    break
            match = pattern.search(text, after)
        found = sorted([*found, *fresh])
    return found


def _taken(found: list[tuple[int, int, str, str]], start: int, end: int) -> bool:
    """Whether a sorted list without overlaps holds something within start and end."""
    low, high = 0, len(found)
    while low < high:
        middle = (low + high) // 2
        if found[middle][1] <= start:
            low = middle + 1
        else:
            high = middle
    return low < len(found) and found[low][0] < end


def pseudonymised(text: str, key: str, back: bool = False) -> dict:
    at, parts, spans = 0, [], []
    for start, end, kind, pseudonym in replacements(text, key, back):
        parts += [text[at:start], pseudonym]
        spans.append({"kind": kind, "start": start, "end": end, "pseudonym": pseudonym})
        at = end
    counts = Counter(span["kind"] for span in spans)
    return {"content": "".join([*parts, text[at:]]), "spans": spans} | {f"n_{k}": counts[k] for k in KINDS}


CHANGED = (
    "content string, spans array<struct<kind: string, start: int, end: int, pseudonym: string>>, "
    + ", ".join(f"n_{kind} int" for kind in KINDS)
)


def pseudonyms(content: Column, key: str, back: bool = False) -> Column:
    """struct of CHANGED; places are those in the given text, in code points."""
    return per_text(lambda text: pseudonymised(text, key, back), f"struct<{CHANGED}>", content)


def pseudonymise_files(files: DataFrame, key: str) -> DataFrame:
    """One row per file: file_id, content with pseudonyms, their spans, and n_<kind>.

    ``files``: file_id, content; other columns are not read. A null text gives an empty one. Rows
    are independent, so repeated rows give the same result.
    """
    return files.select("file_id", pseudonyms(F.col("content"), key).alias("x")).select("file_id", "x.*")
