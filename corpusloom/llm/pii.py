"""Personal data under format-preserving pseudonyms.

Numbers and dates that pass their kind's own check (Luhn, mod 97, valid calendar day, valid number
plan) and addresses, keys and secrets in fixed forms are replaced by others of the same form. A
value is an integer in the set of valid values of its kind; a keyed Feistel network permutes that
set, walking along its cycle while a result falls outside, and the result is written in the value's
own layout with fresh check digits. So the same value becomes the same pseudonym in every document,
different values stay different, nothing is looked up and nothing is shuffled. Sets of less than
``TINY`` values are shifted by a keyed amount that is never zero instead.

Texts are searched whole, in time linear in their length: every pattern is bounded, or begins where
nothing before it could have. Those without a digit, an ``@`` or a name of a secret are passed on
without a look.

What only looks like a value stays: a secret has letters and digits, or capitals and small letters
beyond a first capital; numbers after ``version`` or ``v`` are no date.

Defined cases: null text stays null with no values; overlapping matches: the earliest, then the
first kind below, wins; repeated rows are treated alike; an empty table gives no rows; other columns
are kept by ``pseudonymize``.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROUNDS, TINY = 8, 1000


def permute(x: int, size: int, key: bytes, undo: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse."""
    if size < 2:
        return x
    if size < TINY:
        shift = 1 + int.from_bytes(hashlib.blake2b(b"%d" % size, key=key).digest(), "big") % (size - 1)
        return (x + (-shift if undo else shift)) % size
    half = ((size - 1).bit_length() + 1) // 2
    mask, wide = (1 << half) - 1, (half + 7) // 8

    def mix(i: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(v.to_bytes(wide, "big"), key=key, digest_size=min(64, wide), person=b"%d/%d" % (i, half)).digest(), "big") & mask

    while True:
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            left, right = (right ^ mix(i, left), left) if undo else (right, left ^ mix(i, right))
        x = left << half | right
        if x < size:
            return x


def relabel(value: str, key: bytes, alphabets: list[str]) -> str:
    """Permute a string in which the i-th letter is one of alphabets[i]."""
    x, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    x, out = permute(x, size, key), []
    for a in reversed(alphabets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def same_classes(value: str, key: bytes) -> str:
    """Permute digits, small and capital letters within their kinds; other signs stay."""
    kinds = [next((a for a in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in a), c) for c in value]
    return relabel(value, key, kinds)


def laid_out(template: str, digits: str) -> str:
    """``digits`` in the places of the template's digits."""
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in template)


def luhn(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


#: Fixed: first digits that issuers of cards have (from, to), and the lengths of their numbers.
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14, 16, 19)), ("3095", "3095", (14, 16, 19)), ("36", "36", (14, 16, 19)),
    ("38", "39", (14, 16, 19)), ("3528", "3589", (16, 17, 18, 19)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)), ("62", "62", (16, 17, 18, 19)), ("2200", "2204", (16, 17, 18, 19)),
    ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)), ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)), ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)), ("5893", "5893", (13, 14, 15, 16, 17, 18, 19)),
    ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)), ("6759", "6759", (13, 14, 15, 16, 17, 18, 19)), ("6761", "6763", (13, 14, 15, 16, 17, 18, 19)),
)


def card(m: re.Match, key: bytes) -> str | None:
    """The issuer's digits stay, the others are permuted."""
    d = re.sub(r"\D", "", m[0])
    own = next((len(lo) for lo, hi, lengths in ISSUERS if len(d) in lengths and lo <= d[: len(lo)] <= hi), None)
    if own is None or luhn(d[:-1]) != int(d[-1]):
        return None
    body = d[:own] + relabel(d[own:-1], key, [string.digits] * (len(d) - own - 1))
    return laid_out(m[0], body + str(luhn(body)))


def iban(m: re.Match, key: bytes) -> str | None:
    v = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = same_classes(v[4:], key)
    out = iter(v[:2] + f"{98 - number(body + v[:2] + '00') % 97:02d}" + body)
    return "".join(" " if c == " " else next(out) for c in m[0])


def phone(m: re.Match, key: bytes) -> str | None:
    d = re.sub(r"\D", "", m["rest"])
    head = m[0][: len(m[0]) - len(m["rest"])]
    if len(d) == 10 and d[0] in "23456789" and d[3] in "23456789":
        kinds = [string.digits[2:] if i in (0, 3) else string.digits for i in range(10)]
    elif m["plus"] and 7 <= len(d) <= 14:
        kinds = [string.digits] * len(d)
    else:
        return None
    return head + laid_out(m["rest"], relabel(d, key, kinds))


def ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    x = permute((((area - 1 - (area > 666)) * 99) + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Fixed: the calendar days that dates are permuted in.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def date(m: re.Match, key: bytes) -> str | None:
    if (m["sep2"] or m["sep1"]) == "." and _of_version(m):
        return None
    order = "ymd" if m["y1"] else "dmy" if m["sep2"] == "." or int(m["b"]) <= 12 < int(m["a"]) else "mdy"
    parts = (m["y1"], m["m1"], m["d1"]) if m["y1"] else (m["a"], m["b"], m["y2"])
    at = dict(zip(order, parts, strict=True))
    try:
        day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"]))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = FIRST_DAY + datetime.timedelta(permute((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key))
    new_at = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return (m["sep1"] or m["sep2"]).join(new_at[k] for k in order)


def address(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _of_version(m: re.Match) -> bool:
    return bool(re.search(r"(?i)(?<![a-z])(?:version|ver|v|release|section|chapter)[ .:]{0,2}\Z", m.string[max(0, m.start() - 12) : m.start()]))


def local_part(m: re.Match) -> str:
    """What stands before an address's ``@``, 64 signs at most."""
    return re.search(r"[A-Za-z0-9._%+\-]*\Z", m.string[max(0, m.start() - 64) : m.start()])[0]


def email(m: re.Match, key: bytes) -> str | None:
    local = local_part(m)
    return same_classes(local, key) + m[0] if local else None


def cloud_key(m: re.Match, key: bytes) -> str | None:
    return m[0][:4] + relabel(m[0][4:], key, ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if not re.search("[0189]", m[0][4:]) else string.ascii_uppercase + string.digits] * 16)


def secret(m: re.Match, key: bytes) -> str | None:
    v = m["secret"]
    if not (re.search(r"\d", v) and re.search("[A-Za-z]", v) or re.search("[a-z]", v[1:]) and re.search("[A-Z]", v[1:])) and not re.fullmatch(r"\d{8,}", v):
        return None
    hexed = re.fullmatch(r"[0-9a-f]+", v) and re.search(r"\d", v)
    return m[0][: m.start("secret") - m.start()] + (relabel(v, key, ["0123456789abcdef"] * len(v)) if hexed else same_classes(v, key)) + m[0][m.end("secret") - m.start() :]


#: (kind, pattern, maker) in order of precedence where matches begin together.
KINDS: tuple[tuple[str, str, Callable[[re.Match, bytes], str | None]], ...] = (
    ("email", r"@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?", email),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key))\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9+/_\-]{8,})[\"']?", secret),
    ("cloud_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", cloud_key),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", address),
    ("date", r"(?<!\d)(?:(?P<y1>\d{4})(?P<sep1>[\-/.])(?P<m1>\d{1,2})(?P=sep1)(?P<d1>\d{1,2})|(?P<a>\d{1,2})(?P<sep2>[\-/.])(?P<b>\d{1,2})(?P=sep2)(?P<y2>\d{4}))(?!\d)", date),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", ssn),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)", card),
    ("phone", r"(?<![\w+])(?:(?P<plus>\+)\d{1,3}[ .\-]?|1[ .\-])?(?P<rest>\(\d{3}\) ?\d{3}[ .\-]?\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|(?(plus)\d{1,4}(?:[ .\-]?\d{2,4}){1,5}|(?!)))(?!\w)", phone),
)
_PATTERNS = [(kind, re.compile(pattern), make) for kind, pattern, make in KINDS]


def found(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text, in order and apart from each other."""
    all_ = []
    for rank, (kind, pattern, make) in enumerate(_PATTERNS):
        at = 0
        while m := pattern.search(text, at):
            new = make(m, hashlib.blake2b(kind.encode(), key=key).digest())
            if new is not None:
                start = m.start() - len(local_part(m)) if kind == "email" else m.start()
                all_.append((start, rank, m.end(), kind, new))
            at = m.end() if new is not None else m.start() + 1
    out, end = [], 0
    for start, _, stop, kind, new in sorted(all_):
        if start >= end:
            out.append((start, stop, kind, new))
            end = stop
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[str]]:
    """A text under pseudonyms, and the kinds of what was replaced."""
    parts, at, kinds = [], 0, []
    for start, stop, kind, new in found(text, key):
        parts += [text[at:start], new]
        at = stop
        kinds.append(kind)
    return "".join([*parts, text[at:]]) if parts else text, kinds


def pseudonymize(docs: DataFrame, key: bytes, kinds_as: str = "_kinds") -> DataFrame:
    """``docs`` with ``text`` under pseudonyms, and a last column ``kinds_as``, what was replaced in it;
    its name is lengthened by ``_`` where ``docs`` has a column of it."""
    kinds_as = common.free_name(docs.columns, kinds_as)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(where)
            look = pc.fill_null(pc.match_substring_regex(old, "[0-9@]|(?i)(password|passwd|pwd|secret|token|key)"), False).to_pylist()
            texts, kinds = [], []
            for t, l in zip(old, look, strict=True):
                new, own = replaced(t.as_py(), key) if l else (t.as_py(), [])
                texts.append(new)
                kinds.append(own)
            columns = list(b.columns)
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], [*b.schema.names, kinds_as])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(kinds_as, T.ArrayType(T.StringType()))]))


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows (doc_id, text, n_values, kinds): kinds as ``card:1,email:2``."""
    done = pseudonymize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    kinds = F.array_sort(F.array_distinct("_kinds"))
    named = F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter("_kinds", lambda x: x == k)).cast("string"))), ",")
    return done.select("doc_id", "text", F.size("_kinds").cast("long").alias("n_values"), named.alias("kinds"))
