"""Format-preserving pseudonyms: personal values become other values of the same format.

Every value is ranked within its format (a mixed-radix number), permuted by a keyed Feistel network
with cycle walking, and written back. Equal values stay equal in all documents, different ones stay
different, and the key's owner can turn a pseudonym back. Values are validated first, so look-alikes
(a long number that fails its check digit, an address octet over 255) are left as they are:

* card: 13 to 19 digits with an issuer's prefix and a right check digit; the new check digit is right;
* iban: its country's length and the right mod-97 remainder; the new check digits are right;
* ssn: ddd-dd-dddd in the ranges that are given out, as a group of three and joined digits;
* phone: +c (aaa) nnn-nnnn and the like with 7 to 15 digits in groups; the country code stays; without one also
  aaa nnn nnnn, with an area code that doesn't start with 0 or 1;
* ip: four octets; email: letters and digits, of any script, of the address but for the last two labels of its
  domain, whose labels may be of any script too; the local part has a letter or digit;
* date: a valid day from 1900 to 2099, year first or last, which becomes another such day; also with one-digit
  days and months, with years of two digits (of 2000 to 2099) and with English month names. A day becomes the
  same other day in whatever format it is written. For that, days are permuted within classes that every
  format can write: the century, the day's range (to 9, to 12, over 12), and the month's (May, September,
  others with one digit, those with two);
* secret: 32 to 64 hexadecimal digits with letters and digits among them.

A match that fails its test is tried up to each earlier group, then from each later one.
A pseudonym that equals its value is walked on from, so no value stays in the text. Finding and replacing take time
in proportion to the text, whatever the number of values.

The key is the caller's. `key_of` reads it from the session's setting `spark.gradeloom.pseudonym.key`; where that
isn't set, the session gets a random one, so nobody can turn its pseudonyms back, and other sessions' differ.

Cases: a null text stays null with no finds; an empty one stays empty; repeated rows repeat, ties do not
arise; very long texts are read whole; an empty table gives no rows. Other columns are kept by
`mask_documents` and not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The setting that has the key.
KEY_SETTING = "spark.gradeloom.pseudonym.key"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "email", "date", "secret")


class Feistel:
    """Keyed permutation of range(n)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.n, self.half, self.mask = n, half, (1 << half) - 1
        base = hashlib.blake2b(tweak.encode() + b"|" + str(n).encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.keys = [hashlib.blake2b(bytes([r]), key=base).digest() for r in range(ROUNDS)]
        self.width = (half + 7) // 8

    def _f(self, r: int, x: int) -> int:
        d = hashlib.blake2b(x.to_bytes(self.width, "big"), key=self.keys[r], digest_size=min(64, self.width + 8)).digest()
        return int.from_bytes(d, "big") & self.mask

    def _once(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in range(ROUNDS):
            a, b = b, a ^ self._f(r, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(ROUNDS)):
            a, b = b ^ self._f(r, a), a
        return a << self.half | b

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows digits."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return str(-total % 10)


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FOREIGN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLACE = {c: (a, i) for a in (*_ALPHABETS, _FOREIGN, _FOREIGN.upper().replace("SS", "")) for i, c in enumerate(a)}


@lru_cache(4096)
def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a letter or digit and its place there; of others than the above the letters of one kind on its
    page of 256 characters, or on wider ones if it's alone there."""
    if c in _PLACE or not c.isalnum():
        return _PLACE.get(c)
    kind = unicodedata.category(c)
    for page in (0x100, 0x1000, 0x110000):
        low = ord(c) // page * page
        own = "".join(x for x in map(chr, range(low, min(low + page, 0x110000))) if x not in _PLACE and unicodedata.category(x) == kind and x.isalnum())
        if len(own) > 1:
            return own, own.index(c)
    return None


class Pseudonyms:
    """Permutations of one key by kind and format; they are made when first used."""

    def __init__(self, key: bytes):
        self.key = key
        self._made: dict[tuple[str, int], Feistel] = {}

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """x's image. Fixed points are swapped out in pairs of neighbours' images, see `_shift`."""
        f = self._made.get((kind, n))
        if f is None:
            if len(self._made) > 4096:
                self._made.clear()
            f = self._made[kind, n] = Feistel(self.key, kind, n)
        if n < 2:
            return x
        # A permutation p without fixed points: conjugate of x -> x + 1 by the network.
        return f.encrypt((f.decrypt(x) + (-1 if back else 1)) % n)

    def characters(self, kind: str, text: str, back: bool = False) -> str:
        """Letters and digits permuted within their classes; all else stays where it is."""
        spots = [(i, *found) for i, c in enumerate(text) if (found := _place(c))]
        n, x = 1, 0
        for _, alphabet, k in spots:
            n, x = n * len(alphabet), x * len(alphabet) + k
        shape = "".join(a[0] for _, a, _ in spots)
        x = self.permute(f"{kind}:{shape}", n, x, back)
        out = list(text)
        for i, alphabet, _ in reversed(spots):
            x, k = divmod(x, len(alphabet))
            out[i] = alphabet[k]
        return "".join(out)

    def digits(self, kind: str, text: str, back: bool = False) -> str:
        """The digits of a text permuted together, its other characters kept."""
        own = re.sub(r"[^0-9]", "", text)
        new = iter(str(self.permute(f"{kind}:{len(own)}", 10 ** len(own), int(own), back)).zfill(len(own)))
        return re.sub(r"[0-9]", lambda _: next(new), text)

    def card(self, text: str, back: bool = False) -> str:
        own = re.sub(r"[^0-9]", "", text)
        n = len(own) - 2  # the first digit stays, the last one checks
        body = own[0] + str(self.permute(f"card:{own[0]}", 10**n, int(own[1:-1]), back)).zfill(n)
        new = iter(body + luhn_digit(body))
        return re.sub(r"[0-9]", lambda _: next(new), text)

    def iban(self, text: str, back: bool = False) -> str:
        own = text.replace(" ", "")
        body = self.characters(f"iban:{own[:2]}", own[4:], back)
        new = iter(own[:2] + str(98 - iban_remainder(own[:2] + "00" + body)).zfill(2) + body)
        return re.sub(r"[0-9A-Z]", lambda _: next(new), text)

    def ssn(self, text: str, back: bool = False) -> str:
        area, group, serial = map(int, text.split("-"))
        area -= 1 + (area > 666)
        x = (area * 99 + group - 1) * 9999 + serial - 1
        x = self.permute("ssn", 898 * 99 * 9999, x, back)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, text: str, back: bool = False) -> str:
        m = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        head = m.group() if m else ""
        if _BLANK_PHONE.fullmatch(text):
            while True:  # the area code's first digit is walked into its range
                text = self.digits("phone: ", text, back)
                if is_phone(text):
                    return text
        return head + self.digits("phone", text[len(head) :], back)

    def ip(self, text: str, back: bool = False) -> str:
        x = self.permute("ip", 2**32, int.from_bytes(bytes(map(int, text.split("."))), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def email(self, text: str, back: bool = False) -> str:
        m = re.search(r"[^.@]+\.[^.@]+$", text)
        return self.characters("email", text[: m.start()], back) + m.group()

    def date(self, text: str, back: bool = False) -> str:
        day, write = read_date(text)
        name = _class_of(day)
        days = _days_of(name)
        x = self.permute(f"date:{name}", len(days), int(np.searchsorted(days, day.toordinal())), back)
        return write(datetime.date.fromordinal(int(days[x])))

    def secret(self, text: str, back: bool = False) -> str:
        """The digits 0 to f as one number; a result without a letter or a digit is walked on from."""
        upper = text.upper() == text
        x = int(text, 16)
        while True:
            x = self.permute(f"secret:{len(text)}", 16 ** len(text), x, back)
            out = f"{x:0{len(text)}x}"
            if is_secret(out):
                return out.upper() if upper else out


_MONTHS = "january february march april may june july august september october november december".split()
#: Short names; May has no other, so it counts as a long one only.
_SHORT = {name[:3]: i for i, name in enumerate(_MONTHS, 1) if i != 5} | {"sept": 9}
_NAME = "|".join([*_MONTHS, "sept", *(x for x in _SHORT if x != "sept")])
_NAMED_DATE = re.compile(
    rf"(?P<d1>[0-9]{{1,2}})(?P<o1>st|nd|rd|th)?(?P<s1>[ -]|\ of\ )(?P<m1>{_NAME})(?P<s2>\.?,?[ -])(?P<y1>[0-9]{{4}})"
    rf"|(?P<m2>{_NAME})(?P<s3>\.?[ ])(?P<d2>[0-9]{{1,2}})(?P<o2>st|nd|rd|th)?(?P<s4>,?[ ])(?P<y2>[0-9]{{4}})", re.IGNORECASE | re.ASCII)
_NUMBER_DATE = re.compile(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})")
_YEAR_FIRST = re.compile(r"([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})")
#: Months that are permuted among themselves: May has no short name, September has two, others have one digit or two.
_MONTH_CLASS = (1, 1, 1, 1, 5, 1, 1, 1, 9, 10, 10, 10)


def _class_of(day: datetime.date) -> tuple[bool, int, int]:
    return day.year >= 2000, (day.day > 9) + (day.day > 12), _MONTH_CLASS[day.month - 1]


@lru_cache(64)
def _days_of(name: tuple[bool, int, int]) -> np.ndarray:
    """Ordinals of all days of a class."""
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    return np.array([n for n in range(first, last + 1) if _class_of(datetime.date.fromordinal(n)) == name])


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _valid(year: int, month: int, day: int) -> datetime.date | None:
    try:
        return datetime.date(year, month, day) if 1900 <= year <= 2099 else None
    except ValueError:
        return None


def read_date(text: str) -> tuple[datetime.date, Callable[[datetime.date], str]] | None:
    """A valid date of 1900 to 2099 and what writes another one of its class in its format; day first where both
    readings are right."""
    if m := _YEAR_FIRST.fullmatch(text):
        found = _valid(int(m[1]), int(m[3]), int(m[4]))
        return (found, lambda x: f"{x.year:04d}{m[2]}{x.month:02d}{m[2]}{x.day:02d}") if found else None
    if m := _NUMBER_DATE.fullmatch(text):
        mark, short = m[2], len(m[4]) == 2
        for d, mo in ((1, 3), (3, 1)):
            found = _valid(int(m[4]) + 2000 * short, int(m[mo]), int(m[d]))
            if found:

                def write(x: datetime.date, d: int = d) -> str:
                    numbers = {d: f"{x.day:0{len(m[d])}d}", 4 - d: f"{x.month:0{len(m[4 - d])}d}"}
                    return f"{numbers[1]}{mark}{numbers[3]}{mark}" + (f"{x.year % 100:02d}" if short else f"{x.year:04d}")

                return found, write
        return None
    m = _NAMED_DATE.fullmatch(text)
    if not m:
        return None
    k = "1" if m["d1"] else "2"
    name, d, suffix = m["m" + k], m["d" + k], m["o" + k] or ""
    low = name.lower()
    style = str.upper if name.isupper() else str.lower if name.islower() else str.title
    found = _valid(int(m["y" + k]), _MONTHS.index(low) + 1 if low in _MONTHS else _SHORT[low], int(d))

    def spell(x: datetime.date) -> str:
        new = style(_MONTHS[x.month - 1] if low in _MONTHS else "sept" if low == "sept" else _MONTHS[x.month - 1][:3])
        end = (_ordinal(x.day).upper() if suffix.isupper() else _ordinal(x.day)) if suffix else ""
        own = f"{x.day:0{len(d)}d}{end}"
        return f"{own}{m['s1']}{new}{m['s2']}{x.year:04d}" if k == "1" else f"{new}{m['s3']}{own}{m['s4']}{x.year:04d}"

    return (found, spell) if found else None


def is_secret(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def is_card(text: str) -> bool:
    own = re.sub(r"[^0-9]", "", text)
    return 13 <= len(own) <= 19 and (own[0] in "3456" or "2221" <= own[:4] <= "2720") and luhn_digit(own[:-1]) == own[-1]


def is_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: Characters of an IBAN by country, as the public registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def is_iban(text: str) -> bool:
    own = text.replace(" ", "")
    return len(own) == IBAN_LENGTHS.get(own[:2]) and iban_remainder(own) == 1


_BLANK_PHONE = re.compile(r"[0-9]{3} [0-9]{3} [0-9]{4}")


def is_phone(text: str) -> bool:
    if _BLANK_PHONE.fullmatch(text) and text[0] in "01":
        return False
    return 7 <= sum(c.isdigit() for c in text) <= 15


def is_ip(text: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))


#: Longer and stricter formats first; a match that fails its test is left to the next format.
_EDGE, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_FINDERS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("secret", re.compile(_EDGE + r"(?=[0-9a-fA-F]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + _END), is_secret),
    ("iban", re.compile(_EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _END), is_iban),
    ("date", re.compile(_EDGE + r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})" + _END), lambda x: read_date(x) is not None),
    ("date", re.compile(rf"{_EDGE}(?<![0-9][-/.])(?:[0-9]{{1,2}}/[0-9]{{1,2}}/(?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}}([-.])[0-9]{{1,2}}\1[0-9]{{4}}|[0-9]{{2}}([-.])[0-9]{{2}}\2[0-9]{{2}}){_END}(?![-/.][0-9])"), lambda x: read_date(x) is not None),
    ("date", re.compile(rf"{_EDGE}(?:[0-9]{{1,2}}(?:st|nd|rd|th)?(?:[ -]|\ of\ )(?:{_NAME})\.?,?[ -][0-9]{{4}}|(?:{_NAME})\.?\ [0-9]{{1,2}}(?:st|nd|rd|th)?,?\ [0-9]{{4}}){_END}", re.IGNORECASE | re.ASCII), lambda x: read_date(x) is not None),
    ("ssn", re.compile(_EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END), is_ssn),
    ("ip", re.compile(r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])"), is_ip),
    ("card", re.compile(_EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _END), is_card),
    ("phone", re.compile(r"(?<![0-9A-Za-z_+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})" + _END), is_phone),
)
_LOCAL = r"[^\s@<>()\[\]{},;:\"'|\\/=]"
#: A local part from where its run of characters starts, so that a run is read once, and a domain of labels.
_EMAIL = re.compile(rf"(?<!{_LOCAL})({_LOCAL}++)@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{{2,24}}(?!\w)")
_DIGIT = re.compile(r"[0-9]")


def _longest(m: re.Match, kind: str, test: Callable[[str], bool]) -> tuple[int, int, str] | None:
    """The match if it is valid, or else its longest valid beginning that ends with a group."""
    value = m.group()
    while not test(value):
        cut = max(value.rfind(c) for c in " -.")
        if cut <= 0 or kind not in ("phone", "iban", "card"):
            return None
        value = value[:cut].rstrip(" -.")
    return m.start(), m.start() + len(value), kind


_GROUP = re.compile(r"[ .-]")


def _spans(pattern: re.Pattern, text: str, at: int, kind: str, test: Callable[[str], bool]) -> Iterator[tuple[int, int, str]]:
    """Valid matches; after one that fails the search goes on from its next group."""
    while m := pattern.search(text, at):
        found = _longest(m, kind, test)
        if found:
            yield found
            at = found[1]
        else:
            cut = _GROUP.search(text, m.start() + 1, m.end())
            at = cut.end() if cut else m.end()


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses. A local part in letters with case or digits doesn't reach into letters without case before it, as these
    scripts set no blanks between words."""
    if "@" not in text:
        return
    for m in _EMAIL.finditer(text):
        local, start = m[1], m.start()
        last = next((c for c in reversed(local) if c.isalnum()), None)
        if last is None:
            continue
        if unicodedata.category(last) != "Lo":
            start += max((i + 1 for i, c in enumerate(local) if not c.isascii() and unicodedata.category(c) == "Lo"), default=0)
        yield start, m.end(), "email"


def _blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], "\0" * (b - a)]
        at = b
    return "".join([*out, text[at:]]) if spans else text


def find_personal(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of validated values, without overlaps, in the order of the text."""
    found = list(_emails(text))
    first = _DIGIT.search(text)
    if first:
        # Every number format has a digit near its start: look only from a little before the first digit.
        start = max(0, first.start() - 70)
        # What is found is blanked out, so that a later format can't reach into it.
        open_ = _blanked(text, found)
        for kind, pattern, test in _FINDERS:
            spans = list(_spans(pattern, open_, start, kind, test))
            found += spans
            open_ = _blanked(open_, spans)
    return sorted(found)


def mask_text(text: str, made: Pseudonyms, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    found = find_personal(text)
    if not found:
        return text, found
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], getattr(made, kind)(text[a:b], back)]
        at = b
    return "".join([*out, text[at:]]), found


_RESULT = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in KINDS)])


def _masker(key: bytes):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = Pseudonyms(key)
        for texts in batches:
            rows = []
            for text in texts:
                if text is None:
                    rows.append((None, *[0] * len(KINDS)))
                    continue
                new, found = mask_text(text, made)
                kinds = [k for _, _, k in found]
                rows.append((new, *(kinds.count(k) for k in KINDS)))
            yield pd.DataFrame(rows, columns=["text", *KINDS])

    return F.pandas_udf(run, _RESULT)


def key_of(spark: SparkSession) -> bytes:
    """The session's key; a random one is set where there is none."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def masked_column(docs: DataFrame, name: str, key: bytes, text: str = "text") -> DataFrame:
    """docs with a column `name`: the new text and the number of finds of each kind."""
    return docs.withColumn(name, _masker(key)(F.col(text)))


def mask_documents(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in place of personal values, in the columns of docs."""
    q = "__pii"
    out = masked_column(docs, q, key, text)
    return out.select(*(F.col(f"{q}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
