"""Personal data under format-preserving pseudonyms: numbers and dates permuted by a keyed Feistel network.

A value is validated, mapped to its place among all valid values of its format, permuted there, and written in the same
form. The permutation depends on the key, the kind and the format only, so equal values stay equal across documents,
different ones stay different, and the holder of the key can undo it. No state is shared, so no rows are shuffled.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, schema


class Feistel:
    """A keyed permutation of range(size) for any size: balanced rounds over the next even number of bits, walked on
    along its cycle until the value is in the range."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        wide = (bits + 7) // 8
        text = bytes([k, len(tweak)]) + tweak + half.to_bytes(wide, "big")
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=min(64, wide)).digest(), "big") & ((1 << bits) - 1)

    def _turn(self, value: int, bits: int, tweak: bytes, order) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for k in order:
            left, right = right, left ^ self._round(tweak, k, right, bits)
        return right << bits | left

    def permute(self, value: int, size: int, tweak: bytes = b"", back: bool = False) -> int:
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        order = range(self.ROUNDS)[:: -1 if back else 1]
        while True:
            value = self._turn(value, bits, tweak, order)
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass the Luhn test."""
    total = sum(d if k % 2 else (2 * d) // 10 + (2 * d) % 10 for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


#: A date's formats: groups are in the order of the letters. Two-digit years are not taken for dates.
DATE_FORMS = {
    "ymd": re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"),
    "dmy": re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})"),
}
_FIRST, _LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

#: What may stand before the @ of an address, as the longest run, and from it on. Each run is read once, so long ones take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(?=@)|[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*")
#: Four numbers behind such a word are a version.
_VERSION = re.compile(r"(?:\bv|\bver|\bversion|\brelease|\bbuild)[ .:=]*\Z", re.I)

#: Candidates of the other kinds, longer ones first; validation decides. Each looks at a bounded number of signs, or starts
#: at the start of a run only, so no text takes more than linear time. Fixed formats.
_FOUND = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))"
    r"|(?P<number>(?<![\d])\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<!\d)\d{12,19}(?!\d))"
)


def _addresses(text: str):
    """(start, end) of what looks like an e-mail address: found from its @, from left to right."""
    if "@" not in text:
        return
    for m in _LOCAL.finditer(text):
        if m.end() < len(text) and text[m.end()] == "@" and text[m.end() - 1] not in "._%+-" and (d := _DOMAIN.match(text, m.end())):
            labels = d[0].split(".")  # up to the last that is a top-level domain; none of those before may be empty
            while len(labels) > 1 and not (labels[-1].isalpha() and len(labels[-1]) > 1):
                if (top := re.match("[A-Za-z]{2,}", labels[-1])):
                    labels[-1] = top[0]
                    break
                labels.pop()
            if len(labels) > 1 and not labels[0].endswith("-"):
                yield m.start(), m.end() + len(".".join(labels))


class _Days:
    """The dates that a pseudonym may be, by class: days are as long as they are, and month first or not, in every format."""

    made = None

    @staticmethod
    def kind(day: datetime.date) -> tuple[bool, int]:
        return day.month > 9, 0 if day.day < 10 else 1 if day.day < 13 else 2

    @classmethod
    def of(cls, day: datetime.date) -> list[int]:
        if cls.made is None:
            found: dict = {}
            for o in range(_FIRST.toordinal(), _LAST.toordinal() + 1):
                found.setdefault(cls.kind(datetime.date.fromordinal(o)), []).append(o)
            cls.made = found
        return cls.made[cls.kind(day)]


class Pseudonyms:
    """The pseudonym of every valid value, and back."""

    def __init__(self, key: bytes, back: bool = False):
        self.net, self.back = Feistel(key), back
        self.kinds: dict[str, Callable[[str], tuple[str, str] | None]] = {k: getattr(self, f"_{k}") for k in ("iban", "secret", "ip", "date", "ssn", "phone", "number")}

    def _permute(self, value: int, size: int, tweak: str) -> int:
        return self.net.permute(value, size, tweak.encode(), self.back)

    def _digits(self, digits: str, tweak: str) -> str:
        n = len(digits)
        return f"{self._permute(int(digits), 10**n, f'{tweak}{n}'):0{n}d}" if n else ""

    @staticmethod
    def _laid(text: str, digits: str) -> str:
        """digits in the places of text's digits."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in text)

    @staticmethod
    def _plain(text: str) -> str:
        return "".join(c for c in text if c.isdigit())

    def _letters(self, text: str, tweak: str) -> str:
        """Letters and digits of text permuted among those of the same classes; other signs stay."""
        sizes = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        value, size = 0, 1
        for c, n in zip(text, sizes, strict=True):
            value = value * n + (ord(c) - 48 if n == 10 else ord(c.lower()) - 97 if n == 26 else 0)
            size *= n
        form = "".join("9" if n == 10 else "a" if n == 26 else c for c, n in zip(text, sizes, strict=True))
        value, out = self._permute(value, size, tweak + form), []
        for c, n in zip(reversed(text), reversed(sizes), strict=True):
            value, d = divmod(value, n)
            out.append(chr(48 + d) if n == 10 else chr((65 if c.isupper() else 97) + d) if n == 26 else c)
        return "".join(reversed(out))

    def _email(self, text: str):
        local, _, domain = text.rpartition("@")
        *names, top = domain.split(".")
        return "email", f"{self._letters(local, 'email')}@{'.'.join([*(self._letters(x, 'domain') for x in names), top])}"

    def _iban(self, text: str):
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self._letters(plain[4:], "iban" + plain[:2])
        made = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
        return "iban", "".join(c if c == " " else next(made) for c in text)

    def _secret(self, text: str):
        lower = text.lower()
        n = len(lower)
        made = f"{self._permute(int(lower, 16), 16**n, f'secret{n}'):0{n}x}"
        return "secret", made.upper() if text.isupper() else made

    def _ip(self, text: str):
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        made = self._permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return "ip", ".".join(map(str, made.to_bytes(4, "big")))

    def _date(self, text: str):
        for form, pattern in DATE_FORMS.items():
            if not (m := pattern.fullmatch(text)):
                continue
            y, month, d = (m[1], m[3], m[4]) if form == "ymd" else (m[4], m[3], m[1])
            swapped = form == "dmy" and int(month) > 12 >= int(d)  # month first
            if swapped:
                month, d = d, month
            try:
                day = datetime.date(int(y), int(month), int(d))
            except ValueError:
                return None
            if not _FIRST <= day <= _LAST:
                return None
            days = _Days.of(day)
            place = self._permute(bisect.bisect_left(days, day.toordinal()), len(days), f"date{_Days.kind(day)}")
            made = datetime.date.fromordinal(days[place])
            a, b, sep = f"{made.month:0{len(month)}d}", f"{made.day:0{len(d)}d}", m[2]
            return "date", f"{made.year}{sep}{a}{sep}{b}" if form == "ymd" else f"{a}{sep}{b}{sep}{made.year}" if swapped else f"{b}{sep}{a}{sep}{made.year}"
        return None

    def _ssn(self, text: str):
        area, group, serial = map(int, text.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._permute(value, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(value, 99)
        area += 1 + (area >= 665)
        return "ssn", f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str):
        digits = self._plain(text)
        if not 7 <= len(digits) <= 15:
            return None
        code = len(m[0]) - 1 if (m := re.match(r"\+\d{1,3}(?!\d)", text)) else 0
        return "phone", self._laid(text, digits[:code] + self._digits(digits[code:], f"phone{digits[:code]}"))

    def _number(self, text: str):
        digits = self._plain(text)
        if 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]:
            body = self._digits(digits[:-1], "card")
            return "card", self._laid(text, body + luhn_digit(body))
        return None

    @staticmethod
    def _passes(candidate: tuple, text: str, start: int, end: int, new: str) -> bool:
        """Whether a candidate that failed would pass with `new` in its text. Such a pseudonym is passed over along the
        cycle, as it could not be undone: it would be read as part of the longer value."""
        a, b, take = candidate
        return take(text[a : max(a, start)] + new[max(0, a - start) : b - start] + text[end : max(b, end)]) is not None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """(the text under pseudonyms, [(start, end in the text, kind, pseudonym)])."""
        found, out, last, at, failed = [], [], 0, 0, []
        addresses = _addresses(text)
        address, other = next(addresses, None), _FOUND.search(text)
        while True:
            while address and (address[1] <= at or text[max(address[0], at)] == "@"):
                address = next(addresses, None)
            if other and other.start() < at:
                other = _FOUND.search(text, at)
            if not address and not other:
                break
            if address and (not other or max(address[0], at) <= other.start()):
                start, ends, take = max(address[0], at), [address[1]], self._email
                address = next(addresses, None)
            else:
                start, take, ends = other.start(), self.kinds[other.lastgroup], [other.end()]
                if other.lastgroup == "ip" and _VERSION.search(text, max(0, start - 16), start):
                    at = other.end()
                    continue
                if other.lastgroup in ("number", "iban"):  # a value may be followed by what looks like another group of it
                    ends += [k for k in range(other.end() - 1, start, -1) if text[k] in " -"]
            at = max(at, start + (take != self._email))
            for end in ends:
                if made := take(text[start:end]):
                    kind, new = made
                    failed = [x for x in failed if x[1] > start]
                    while any(self._passes(x, text, start, end, new) for x in failed):
                        kind, new = take(new)
                    found.append((start, end, kind, new))
                    out += (text[last:start], new)
                    last = at = end
                    failed = []
                    break
                failed.append((start, end, take))
        return ("".join([*out, text[last:]]), found) if found else (text, found)


_MAYBE = re.compile(r"[0-9@]")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())])


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, n_found, found): the texts under pseudonyms, and where which kinds of values were, in code points of the
    text given. back undoes pseudonyms of the same key.

    Null texts stay null with nothing found. Rows are taken one by one, so repeated rows give the same again. Other columns are
    ignored. Kinds: card (Luhn), iban (mod 97), date, ssn, ip, phone, email, secret (long hex); long numbers that fail
    their check are left alone, as are four numbers behind a word such as version. A day has one pseudonym in all formats, of
    the same length in each. Of an address, only the top-level domain stays. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        names = Pseudonyms(key, back)
        for batch in batches:
            done = [(t, []) if t is None or not _MAYBE.search(t) else names.replace(t) for t in batch["text"].to_pylist()]
            spans = [[dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in f] for _, f in done]
            yield batch_of({"doc_id": (batch["doc_id"], pa.int64()), "text": ([t for t, _ in done], pa.string()), "n_found": ([len(f) for _, f in done], pa.int64()), "found": (spans, pa.list_(_SPAN))})

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(run, schema(doc_id="long", text="string", n_found="long", found="array<struct<start:int,`end`:int,kind:string,pseudonym:string>>"))
