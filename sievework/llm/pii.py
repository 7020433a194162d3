"""Personal data: format-preserving pseudonyms by keyed Feistel permutations."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces

_ROUNDS = 8


def _noise(key: bytes, tweak: str, i: int, x: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{i}|{x}".encode(), "sha256"), "big")


def permute(key: bytes, tweak: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size), by a Feistel network over about square halves and cycle walking."""
    b = max(1, math.isqrt(size - 1) + 1)
    a = -(-size // b)
    while True:
        left, right = divmod(x, b)
        for i in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _noise(key, tweak, i, left)) % b
            else:
                left = (left + sign * _noise(key, tweak, i, right)) % a
        x = left * b + right
        if x < size:
            return x


def pseudonym(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size) that leaves nothing in place (where size is over 1): a step along a keyed cycle."""
    return permute(key, tweak, (permute(key, tweak, x, size) + 1) % size, size, back=True)


def _by_places(key: bytes, tweak: str, text: str, alphabets: list[str], member: Callable[[str], bool] | None = None) -> str:
    """text, each character of which stands in its place's alphabet, permuted among all such texts; with member, among those of
    them that it holds true, by walking on along the cycle until the next one."""
    x, size = 0, 1
    for c, letters in zip(text, alphabets, strict=True):
        x, size = x * len(letters) + letters.index(c), size * len(letters)
    while True:
        x = rest = pseudonym(key, f"{tweak}|{len(text)}|{size}", x, size)
        out = []
        for letters in reversed(alphabets):
            rest, i = divmod(rest, len(letters))
            out.append(letters[i])
        new = "".join(reversed(out))
        if member is None or member(new):
            return new


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _alphabet(c: str) -> str:
    return next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), c)


def _digits_in(text: str, new: str) -> str:
    """text with its digits replaced in turn by those of new."""
    it = iter(new)
    return "".join(next(it) if c in _DIGITS else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that makes digits + it pass."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _card(key: bytes, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return None
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = _by_places(key, "card", digits[:-1], [_DIGITS] * (len(digits) - 1))
    return _digits_in(m[0], body + str(luhn(body)))


def _dialled(digits: str) -> bool:
    """Whether ten digits can be an area and exchange code of the North American plan with a number."""
    return digits[0] in "23456789" and digits[3] in "23456789"


def _phone(key: bytes, m: re.Match) -> str | None:
    code, rest = m["code"] or "", m[0][len(m["code"] or "") :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12:
        return None
    # Ten digits that can be dialled and those that cannot are permuted apart, so that no two get one pseudonym.
    own = None if len(digits) != 10 else _dialled if _dialled(digits) else lambda x: not _dialled(x)
    return code + _digits_in(rest, _by_places(key, "phone", digits, [_DIGITS] * len(digits), own))


def _ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = pseudonym(key, "ssn", x, areas * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(key: bytes, m: re.Match) -> str | None:
    try:
        x = int(ipaddress.IPv4Address(m[0]))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(pseudonym(key, "ip", x, 1 << 32)))


_HEX = "0123456789abcdef"


def _ip6(key: bytes, m: re.Match) -> str | None:
    """Groups that are zero stay so; the others are permuted together among groups of as many digits."""
    try:
        value = ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    groups = value.exploded.split(":")
    plain = [g.lstrip("0") for g in groups]
    if sum(map(bool, plain)) < 3:
        return None
    text = "".join(plain)
    places = [_HEX[1:] if i == 0 else _HEX for g in plain for i in range(len(g))]
    new = iter(_by_places(key, "ip6" + ",".join(str(len(g)) for g in plain), text, places))
    names = {g: "".join(next(new) for _ in p) for g, p in enumerate(plain)}
    head, double, tail = m[0].partition("::")
    left, right = (part.split(":") if part else [] for part in (head, tail))
    at = [*range(len(left)), *range(8 - len(right), 8)]
    out = [names[g].rjust(len(old), "0") for g, old in zip(at, left + right, strict=True)]
    if m[0] != m[0].lower():
        out = [g.upper() for g in out]
    return ":".join(out[: len(left)]) + double + ":".join(out[len(left) :])


def _iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _iban(key: bytes, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = _by_places(key, "iban" + plain[:2], plain[4:], [_alphabet(c) for c in plain[4:]])
    it = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ibans(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches that pass their check, each the longest of those that end where the whole match or a group of it ends: a word or
    number that follows an IBAN may look like its last group. What a match leaves over is read again."""
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        for end in (m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")):
            plain = text[m.start() : end].replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4] and (own := pattern.fullmatch(text, m.start(), end)):
                yield own
                at = end
                break


def _email(key: bytes, m: re.Match) -> str:
    labels = m["domain"].split(".")
    new = [_by_places(key, "domain", x, [_alphabet(c) for c in x]) for x in labels[:-1]]
    return _by_places(key, "mailbox", m["local"], [_alphabet(c) for c in m["local"]]) + "@" + ".".join([*new, labels[-1]])


#: Characters permuted at once: so few that the noise of a round (256 bits) reaches all of a half.
_CHUNK = 64


def _secret(key: bytes, m: re.Match) -> str:
    value = m["secret"]
    places = [_HEX] * len(value) if set(value) <= set(_HEX) else [_alphabet(c) for c in value]
    out, tweak = m[0][: m.start("secret") - m.start()], "secret"
    # What is over _CHUNK characters is permuted in chunks, each by a permutation that the texts before it choose.
    for at in range(0, len(value), _CHUNK):
        part = value[at : at + _CHUNK]
        out += _by_places(key, tweak, part, places[at : at + _CHUNK])
        tweak = "secret|" + hmac.digest(key, f"{tweak}|{part}".encode(), "sha256").hex()
    return out + m.string[m.end("secret") : m.end()]


def _ranges(month: int, day: int) -> tuple[int, int, int, int]:
    """(first month, months, first day, days) of a date's class: what keeps its month and day as long, written without zeros,
    and keeps a day of over 12 one, so that the order of day and month can still be read off."""
    m0, months = (1, 9) if month < 10 else (10, 3)
    d0, days = (1, 9) if day < 10 else (10, 3) if day < 13 else (13, 19)
    return m0, months, d0, days


def _new_date(key: bytes, old: date) -> date:
    """Permuted within its class, and among the years 1900 to 2099 or those outside of them."""
    m0, months, d0, days = _ranges(old.month, old.day)
    near = 1900 <= old.year <= 2099
    years = 200 if near else 9799
    year = old.year - 1900 if near else old.year - 1 if old.year < 1900 else old.year - 201
    x = (year * months + old.month - m0) * days + old.day - d0
    while True:
        x = pseudonym(key, f"date|{near}|{m0}|{d0}", x, years * months * days)
        rest, day = divmod(x, days)
        year, month = divmod(rest, months)
        year = year + 1900 if near else year + 1 if year < 1899 else year + 201
        with contextlib.suppress(ValueError):  # a month's days run out: the next along the cycle
            return date(year, month + m0, day + d0)


def _date(key: bytes, m: re.Match) -> str | None:
    """Equal dates have equal pseudonyms however they are written; a.b.year is read day first, a/b/year and a-b-year month first
    unless a is over 12."""
    sep = m["sep"]
    parts = m[0].split(sep)
    a, b, c = map(int, parts)
    year_first = len(parts[0]) == 4
    day_first = not year_first and (sep == "." or a > 12)
    try:
        new = _new_date(key, date(a, b, c) if year_first else date(c, b, a) if day_first else date(c, a, b))
    except ValueError:
        return None
    order = (new.year, new.month, new.day) if year_first else (new.day, new.month, new.year) if day_first else (new.month, new.day, new.year)
    return sep.join(str(x).rjust(len(old), "0") for x, old in zip(order, parts, strict=True))


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _worded(key: bytes, m: re.Match) -> str | None:
    """A date whose month is an English word, whole or its first three letters: the pseudonym is its other forms' too."""
    word = m["month"]
    month = next(i for i, name in enumerate(_MONTHS, 1) if name.startswith(word.lower()[:3]))
    try:
        new = _new_date(key, date(int(m["year"]), month, int(m["day"])))
    except ValueError:
        return None
    name = _MONTHS[new.month - 1] if len(word) > 3 or word.lower() == "may" else _MONTHS[new.month - 1][:3]
    name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name
    put = {"month": name, "day": str(new.day).rjust(len(m["day"]), "0"), "year": str(new.year).rjust(4, "0")}
    out, at = "", m.start()
    for part in sorted(put, key=m.start):
        out, at = out + m.string[at : m.start(part)] + put[part], m.end(part)
    return out + m.string[at : m.end()]


#: A name that says that a secret follows, alone or as a part of a longer name, and what stands between them.
_NAMED = r"(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[TSPA]))(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-]?(?i:key|value|token|secret))?(?![A-Za-z0-9])[\"']?\s*[=:]\s*"
_MONTH = r"(?P<month>(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))"

#: In order; what one has replaced isn't seen by the next.
_KINDS = [
    ("email", re.compile(r"(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?P<domain>(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})"), _email),
    ("secret", re.compile(rf"{_NAMED}(?P<quote>[\"'])(?P<secret>[^\"'\n]{{6,}})(?P=quote)"), _secret),
    ("secret", re.compile(rf"{_NAMED}(?=[^\s\"'<>]*[^a-z\s\"'<>]|[^\s\"'<>]{{8}})(?P<secret>[^\s\"'<>]{{5,}}[^\s\"'<>.,;:!?)\]}}])"), _secret),
    ("secret", re.compile(r"(?i:(?<![A-Za-z0-9])bearer\s+)(?=[A-Za-z._~+/=-]*\d)(?P<secret>[A-Za-z0-9._~+/=-]{8,})"), _secret),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<secret>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![A-Za-z0-9])"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(r"(?<![\w.+-])(?:\d{4}(?P<sep>[-/.])\d{1,2}(?P=sep)\d{1,2})(?![\w-]|\.\d)"), _date),
    ("date", re.compile(r"(?<![\w.+-])(?:\d{1,2}(?P<sep>[-/.])\d{1,2}(?P=sep)\d{4})(?![\w-]|\.\d)"), _date),
    ("date", re.compile(rf"(?<![\w.+-])(?P<day>\d{{1,2}})(?:st|nd|rd|th)?\.? (?:of )?{_MONTH}\.?,? (?P<year>\d{{4}})(?!\w)"), _worded),
    ("date", re.compile(rf"(?<!\w){_MONTH}\.? (?P<day>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<year>\d{{4}})(?!\w)"), _worded),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"), _ip),
    ("ip6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?::?[0-9A-Fa-f]{1,4}){0,6}(?![\w:]|\.\d)"), _ip6),
    ("card", re.compile(r"(?<![\w+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w)"), _card),
    ("phone", re.compile(r"(?<![\w.+-])(?P<code>\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])(?P<code>00[1-9]\d{0,2}[ .-])(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])(?P<code>1[ .-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])(?P<code>0)[1-9]\d{1,4}[ /-]\d{5,8}(?![\w-]|\.\d)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])(?P<code>)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)"), _phone),
]
_MARKS = (*_DIGITS, "@")
#: The kinds of which a text without marks may hold one.
_UNMARKED = [pattern for kind, pattern, _ in _KINDS if kind == "secret"]


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """text with each validated value replaced, and how many were. Equal values of a kind have equal pseudonyms under one key."""
    if not any(c in text for c in _MARKS) and not any(p.search(text) for p in _UNMARKED):
        return text, 0
    done: list[tuple[int, int, str]] = []
    used = bytearray(len(text))
    for kind, pattern, replace in _KINDS:
        for m in _ibans(pattern, text) if kind == "iban" else pattern.finditer(text):
            s, e = m.span()
            if not any(used[s:e]) and (new := replace(key, m)) is not None:
                done.append((s, e, new))
                used[s:e] = b"\1" * (e - s)
    done.sort()
    out, at = [], 0
    for s, e, new in done:
        out += text[at:s], new
        at = e
    return "".join([*out, text[at:]]), len(done)


def pseudonymised(docs: DataFrame, secret: str, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """docs with text_col rewritten, and count_col (long; replaces a column of that name). Null texts stay null and count 0;
    all other columns, whatever their names, and every row stay as they are, repeated rows alike and an empty table empty. Equal
    values get equal pseudonyms across all texts under one secret. One pass over whole texts, however long, without a shuffle."""
    key = hashlib.sha256(secret.encode()).digest()
    rows = docs.drop(count_col).withColumn(count_col, F.lit(0).cast("long"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            found = [(None, 0) if t is None else pseudonymise(t, key) for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True))
            columns[text_col] = pa.array([t for t, _ in found], columns[text_col].type)
            columns[count_col] = pa.array([n for _, n in found], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return rows.mapInArrow(run, rows.schema)
