"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Found and validated: payment cards (Luhn, 13 to 19 digits, plain or in groups), US social security
numbers, IBANs (mod 97; the length of the country, where it is a known one), IPv4 addresses, North American phone numbers (area and exchange of 200 to 999, none of N11, no
area N9X), dates of 1900 to 2099 (y-m-d, d.m.y, m/d/y or d/m/y) and e-mail addresses (their local part). What fails its
validation stays. A phone number that says `+1` is told by its format: if no area has it, it is replaced by another such
number, so that valid ones give valid ones and others give others.

Each value is ranked within the set of valid values of its kind and length, the rank is permuted
by a Feistel network on two mixed-radix halves (HMAC-SHA256 rounds; ranks that leave the set are
permuted again until they are back), and the new rank is written in the old value's layout:
separators, prefixes, digit counts stay, check digits are made anew. The permutation is of the
value, not of its spelling, so equal values get equal pseudonyms in every document, and different
values different ones. A date becomes one that all of its spellings can write with as many digits and
that is read by the same rule (days beyond the twelfth, which d/m/y can say, stay among themselves). The key is a parameter without a default; on a cluster take it from a secret store. The query uses DEMO_KEY.

One narrow pass, no shuffle. Defined results: a null text stays null, an empty one empty, both
with no values. Repeated rows give repeated results; an empty table an empty one. Further columns pass
through `pseudonymize` (a column it adds replaces one of the same name).
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, small_batches, table

DEMO_KEY = b"plinth demo key: replace it"
ROUNDS = 10
DAY0, DAYS = datetime.date(1900, 1, 1), 73049

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])(?P<local>[A-Za-z0-9][A-Za-z0-9._+-]{0,63})@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ymd>(?<![0-9.-])[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}(?![0-9]|[-.][0-9]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<dmy>(?<![0-9.-])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9]))"
    r"|(?P<mdy>(?<![0-9/-])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9]|/[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<card>(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?P<s2>[ -])[0-9]{4}(?P=s2)[0-9]{4}(?P=s2)[0-9]{4}|[0-9]{4}(?P<s3>[ -])[0-9]{6}(?P=s3)[0-9]{5})(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
)
#: The length of an IBAN by its country, of the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_LIKELY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


class Permutation:
    """A keyed permutation of range(size), of its own for each tweak."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.tweak = size, f"{tweak}/{size}/".encode()
        self.a = math.isqrt(max(0, size - 1)) + 1
        self.b = -(-size // self.a)
        self.mac = hmac.new(key, self.tweak, hashlib.sha256)

    def _round(self, i: int, half: int) -> int:
        mac = self.mac.copy()
        mac.update(f"{i}/{half}".encode())
        return int.from_bytes(mac.digest(), "big")

    def __call__(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(i, right)) % self.a
                right = (right + self._round(i + 1, left)) % self.b
            x = left * self.b + right
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._round(i + 1, left)) % self.b
                left = (left - self._round(i, right)) % self.a
            x = left * self.b + right
            if x < self.size:
                return x


@lru_cache(maxsize=4096)
def permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def laid_out(digits: str, layout: str) -> str:
    """layout with its digits replaced in order."""
    new = iter(digits)
    return _DIGIT.sub(lambda m: next(new), layout)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _card(key: bytes, text: str) -> str | None:
    digits = "".join(_DIGIT.findall(text))
    if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = str(permutation(key, "card", 10**n)(int(digits[:-1]))).zfill(n)
    return laid_out(body + luhn_digit(body), text)


def _ssn(key: bytes, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permutation(key, "ssn", 898 * 99 * 9999)(rank), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    new = permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, new.to_bytes(4, "big")))


def _has_area(number: int) -> bool:
    """Whether ten digits are a North American number that can be dialled."""
    area, exchange = divmod(number // 10_000, 1000)
    return 200 <= area and 200 <= exchange and area % 100 != 11 and exchange % 100 != 11 and area // 10 % 10 != 9


def _phone(key: bytes, text: str) -> str | None:
    head = "+1" if text.startswith("+1") else ""
    number = int("".join(_DIGIT.findall(text[len(head) :])))
    good, permuted = _has_area(number), permutation(key, "phone", 10**10)
    if not good and not head:
        return None
    number = permuted(number)
    while _has_area(number) != good:  # a permutation of the numbers of one sort
        number = permuted(number)
    return head + laid_out(str(number).zfill(10), text[len(head) :])


def _iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or IBAN_LENGTHS.get(plain[:2], len(plain)) != len(plain) or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    digits = "".join(_DIGIT.findall(plain[4:]))
    shape = _DIGIT.sub("9", plain[4:])
    body = laid_out(str(permutation(key, f"iban/{plain[:2]}/{shape}", 10 ** len(digits))(int(digits))).zfill(len(digits)), plain[4:]) if digits else plain[4:]
    new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


@lru_cache(maxsize=1)
def _sorts() -> tuple[dict[datetime.date, tuple[str, int]], dict[str, list[datetime.date]]]:
    """The days of 1900 to 2099 by what their spellings can be: whether the month needs two digits, the day two, and whether the day is no month."""
    place: dict[datetime.date, tuple[str, int]] = {}
    days: dict[str, list[datetime.date]] = {}
    for at in range(DAYS):
        day = DAY0 + datetime.timedelta(at)
        own = days.setdefault(f"{day.month > 9:d}{day.day > 9:d}{day.day > 12:d}", [])
        place[day] = f"{day.month > 9:d}{day.day > 9:d}{day.day > 12:d}", len(own)
        own.append(day)
    return place, days


def _day(key: bytes, year: str, month: str, day: str) -> datetime.date | None:
    """Another day of the same sort, so that every spelling of the one is a spelling of the other, read in the same way."""
    place, days = _sorts()
    try:
        sort, rank = place[datetime.date(int(year), int(month), int(day))]
    except (ValueError, KeyError):
        return None
    return days[sort][permutation(key, f"date/{sort}", len(days[sort]))(rank)]


def _as(number: int, old: str) -> str:
    return str(number).zfill(len(old))


def _ymd(key: bytes, text: str) -> str | None:
    new = _day(key, text[:4], text[5:7], text[8:])
    return new and f"{new.year}{text[4]}{new.month:02d}{text[7]}{new.day:02d}"


def _dmy(key: bytes, text: str) -> str | None:
    day, month, year = text.split(".")
    new = _day(key, year, month, day)
    return new and f"{_as(new.day, day)}.{_as(new.month, month)}.{new.year}"


def _mdy(key: bytes, text: str) -> str | None:
    first, second, year = text.split("/")
    if new := _day(key, year, first, second):
        return f"{_as(new.month, first)}/{_as(new.day, second)}/{new.year}"
    new = _day(key, year, second, first)
    return new and f"{_as(new.day, first)}/{_as(new.month, second)}/{new.year}"


def _email(key: bytes, text: str) -> str | None:
    local, domain = text.split("@", 1)
    kinds = [("09", 10) if c.isdigit() else ("az", 26) if c.islower() else ("AZ", 26) if c.isupper() else (c, 1) for c in local]
    size, rank = math.prod(n for _, n in kinds), 0
    for c, (k, n) in zip(local, kinds):
        rank = rank * n + (ord(c) - ord(k[0]) if n > 1 else 0)
    rank, out = permutation(key, "email/" + "".join(k[0] for k, _ in kinds), size)(rank), []
    for k, n in reversed(kinds):
        rank, x = divmod(rank, n)
        out.append(chr(ord(k[0]) + x))
    return "".join(reversed(out)) + "@" + domain


KINDS: dict[str, Callable[[bytes, str], str | None]] = {"card": _card, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "ymd": _ymd, "dmy": _dmy, "mdy": _mdy}
NAMES = {"ymd": "date", "dmy": "date", "mdy": "date"}


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end in the old text, pseudonym) of each."""
    if not text or not _LIKELY.search(text):
        return text, []
    out, found, done, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind](key, m[kind])
        if new is None:
            at = m.start() + 1
            while at < m.end() and text[at - 1].isalnum() and text[at].isalnum():
                at += 1
            continue
        out += [text[done : m.start(kind)], new]
        found.append((NAMES.get(kind, kind), m.start(kind), m.end(kind), new))
        done = at = m.end(kind)
    return "".join([*out, text[done:]]), found


SPANS = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with text replaced and the column pii: the kinds, places and pseudonyms."""
    small_batches(docs.sparkSession)
    kind = pa.struct({"new": pa.string(), "pii": pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "pseudonym": pa.string()}))})

    @F.arrow_udf(f"struct<new:string,pii:{SPANS}>")
    def run(texts: pa.Array) -> pa.Array:
        done = [replaced(t, key) for t in texts.to_pylist()]
        names = ("kind", "start", "end", "pseudonym")
        return pa.array([{"new": new, "pii": [dict(zip(names, f)) for f in found]} for new, found in done], kind)

    name = fresh(docs, "_pii")[0]
    rest = [c for c in docs.columns if c.lower() != "pii"]
    with_it = docs.select(*map(col, rest), run(col(text).cast("string")).alias(name))
    return with_it.select(*[F.col(name)["new"].alias(c) if c == text else col(c) for c in rest], F.col(name)["pii"].alias("pii"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(table(spark, sf_dir, "documents", "doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), F.transform("pii", lambda x: x["pseudonym"]).alias("pseudonyms"), F.transform("pii", lambda x: x["kind"]).alias("kinds"), "text")
