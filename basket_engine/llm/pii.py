"""Format-preserving pseudonyms: personal values permuted within their own format.

A value that passes its format's check (check digits, calendar, ranges) is read as a number
below the count of values that the format allows, and a keyed Feistel network permutes
these numbers. Equal values get equal pseudonyms in every document and partition, so they
stay linked; nothing is looked up, collected or shuffled.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .documents import one_per_id
from .wordhash import slices

ROUNDS = 10
#: Stands in where no key is given; a production job passes its own secret.
DEMO_KEY = b"demonstration key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = DIGITS + "abcdef"
KINDS = ("email", "secret", "key_id", "iban", "ipv4", "date", "ssn", "card", "phone")

PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_.~-]{6,})"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<key_id>[0-9A-Z]{16})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![0-9.])(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.?[0-9])"
    r"|(?<![0-9])(?P<date>[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9])"
    r"|(?<![0-9-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])"
    r"|(?<![0-9])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
    r"|(?<![0-9A-Za-z])(?P<phone>\+?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})(?![0-9A-Za-z])"
)


class Remembered:
    """A function beside its ``lru_cache``.

    A cached function is pickled by its name, which only workers with an installed copy of this
    package can look up. This one travels as the function and starts empty on each worker.
    """

    def __init__(self, function: Callable, size: int):
        self.function, self.size = function, size
        self.cached = lru_cache(size)(function)

    def __reduce__(self):
        return Remembered, (self.function, self.size)


def _round(key: bytes, tweak: str, number: int, half: int, right: int) -> int:
    size = (half + 7) // 8
    word = hashlib.blake2b(right.to_bytes(size, "little"), digest_size=min(64, size + 8), key=key, person=f"{tweak}{number}".encode()[:16]).digest()
    while len(word) < size:
        word += hashlib.blake2b(word, digest_size=64, key=key).digest()
    return int.from_bytes(word, "little") & ((1 << half) - 1)


_rounds = Remembered(_round, 1 << 14)


def permuted(x: int, count: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the numbers below ``count``: a balanced Feistel network over
    the next even number of bits, walked until it comes out below ``count``."""
    half = max(1, ((count - 1).bit_length() + 1) // 2)
    mask, rounds = (1 << half) - 1, _rounds.cached
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            if back:
                left, right = right ^ rounds(key, tweak, ROUNDS - 1 - i, half, left), left
            else:
                left, right = right, left ^ rounds(key, tweak, i, half, right)
        x = (left << half) | right
        if x < count:
            return x


def moved(x: int, count: int, key: bytes, tweak: str) -> int:
    """Like ``permuted``, but no number stays: the step to the next one in a keyed order."""
    if count < 2:
        return x
    return permuted((permuted(x, count, key, tweak) + 1) % count, count, key, tweak, back=True)


def _recoded(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """The characters, each within its alphabet, permuted as one mixed-radix number."""
    x, count = 0, 1
    for c, a in zip(text, alphabets):
        x, count = x * len(a) + a.index(c), count * len(a)
    x, out = moved(x, count, key, tweak), []
    for a in reversed(alphabets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _refill(shape: str, fill: str, of: str = DIGITS) -> str:
    """The characters of ``fill`` in the places that hold one of ``of``."""
    left = iter(fill)
    return "".join(next(left) if c in of else c for c in shape)


def _classes(text: str) -> list[str]:
    return [next(a for a in (DIGITS, LOWER, UPPER) if c in a) for c in text]


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _email(v: str, key: bytes) -> str:
    local, _, domain = v.lower().rpartition("@")
    name, dot, top = domain.rpartition(".")
    body = "".join(c for c in local + name if c.isalnum())
    return _refill(f"{local}@{name}", _recoded(body, _classes(body), key, "email"), DIGITS + LOWER) + dot + top


def _secret(v: str, key: bytes) -> str | None:
    body = "".join(c for c in v if c.isalnum())
    if not body:
        return None
    alphabets = [HEX] * len(body) if set(body) <= set(HEX) else _classes(body)
    return _refill(v, _recoded(body, alphabets, key, "secret"), DIGITS + LOWER + UPPER)


def _key_id(v: str, key: bytes) -> str:
    return _recoded(v, [DIGITS + UPPER] * len(v), key, "key_id")


def _iban(v: str, key: bytes) -> str | None:
    flat = v.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _recoded(flat[4:], _classes(flat[4:]), key, "iban" + flat[:2])
    check = 98 - number(body + flat[:2] + "00") % 97
    return _refill(v, f"{flat[:2]}{check:02d}{body}", DIGITS + UPPER)


def _ipv4(v: str, key: bytes) -> str | None:
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
        return None
    x = moved(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(v: str, key: bytes) -> str | None:
    parts = re.split(r"[-/.]", v)
    marks = re.findall(r"[-/.]", v)
    if marks[0] != marks[1]:
        return None
    numbers = [int(p) for p in parts]
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif numbers[1] > 12 or marks[0] == "/" and numbers[0] <= 12:
        order = (2, 0, 1)  # month first
    else:
        order = (2, 1, 0)
    try:
        day = datetime.date(*(numbers[i] for i in order))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    first, count = FIRST_DAY.toordinal(), (LAST_DAY - FIRST_DAY).days + 1
    new = datetime.date.fromordinal(first + moved(day.toordinal() - first, count, key, "date"))
    fields = {}
    for place, value in zip(order, (new.year, new.month, new.day)):
        fields[place] = f"{value:0{len(parts[place])}d}"
    return marks[0].join(fields[i] for i in range(3))


def _ssn(v: str, key: bytes) -> str | None:
    a, b, c = v.split("-")
    if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
        return None
    x = moved(int(a + b + c), 10**9, key, "ssn")
    while True:
        s = f"{x:09d}"
        if s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000":
            return f"{s[:3]}-{s[3:5]}-{s[5:]}"
        x = moved(x, 10**9, key, "ssn")


def _card(v: str, key: bytes) -> str | None:
    d = "".join(c for c in v if c in DIGITS)
    if luhn_digit(d[:-1]) != d[-1] or d[0] == "0":
        return None
    body = _recoded(d[:-1], [DIGITS[1:]] + [DIGITS] * (len(d) - 2), key, "card")
    return _refill(v, body + luhn_digit(body))


def _phone(v: str, key: bytes) -> str | None:
    d = "".join(c for c in v if c in DIGITS)
    # bare digit runs are no phone numbers: these have a plus sign, brackets or gaps
    if not 9 <= len(d) <= 15 or v.isdigit():
        return None
    code = len(d) - 10 if len(d) > 10 else 0
    own = d[code:]
    alphabets = [DIGITS[1:] if i == 0 and own[0] != "0" else DIGITS for i in range(len(own))]
    return _refill(v, d[:code] + _recoded(own, alphabets, key, "phone"))


RULES: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "secret": _secret, "key_id": _key_id, "iban": _iban, "ipv4": _ipv4, "date": _date,
    "ssn": _ssn, "card": _card, "phone": _phone,
}


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with its personal values replaced, and how many of each kind there were.

    A match that fails its format's check is tried again from its second character on, so
    that a value behind it is not missed.
    """
    out, at, last, counts = [], 0, 0, {}
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        lo, hi = m.span(kind)
        new = RULES[kind](m[kind], key)
        while new is None and kind == "card" and (gap := max(text.rfind(" ", lo, hi), text.rfind("-", lo, hi))) > lo + 12:
            hi = gap  # another number behind the card's may have been taken in
            new = _card(text[lo:hi], key) if text[hi - 1] in DIGITS else None
        if new is None:
            at = m.start() + 1
            while at < len(text) and text[at - 1].isdigit() and text[at].isdigit():
                at += 1
            continue
        out += [text[last:lo], new]
        at = last = hi
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[last:]]), counts


def _worker(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                column = batch.column(1)
                some = pc.fill_null(pc.match_substring_regex(column, "[0-9@=:]"), False).to_numpy(zero_copy_only=False)
                texts, counts = column.to_pylist() if some.any() else None, [[0] * batch.num_rows for _ in KINDS]
                for i in some.nonzero()[0]:
                    texts[i], found = pseudonymised(texts[i], key)
                    for kind, n in found.items():
                        counts[KINDS.index(kind)][i] = n
                new = column if texts is None else pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), new, *(pa.array(c, pa.int64()) for c in counts)], ["id", "text", *KINDS]
                )

    return run


def _in_place(key: bytes, text: int, size: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(text)
                some = pc.fill_null(pc.match_substring_regex(column, "[0-9@=:]"), False).to_numpy(zero_copy_only=False)
                if some.any():
                    texts = column.to_pylist()
                    for i in some.nonzero()[0]:
                        texts[i] = pseudonymised(texts[i], key)[0]
                    new = pa.array(texts, column.type)
                    batch = batch.set_column(text, batch.schema.field(text), new)
                    if size is not None:
                        batch = batch.set_column(size, batch.schema.field(size), pc.utf8_length(new).cast(batch.schema.field(size).type))
                yield batch

    return run


def replaced(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The documents with their personal values replaced as by ``pseudonyms`` and all other
    columns as they are; ``size_col`` is set to the text's code points where given."""
    names = docs.columns
    size = names.index(size_col) if size_col in names else None
    return docs.mapInArrow(_in_place(key, names.index(text_col), size), docs.schema)


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_email, n_secret, ..., n_values), one row per document.

    Found are e-mail addresses, passwords and tokens behind their names, cloud key ids,
    IBANs, IPv4 addresses, dates, US social security numbers, payment cards and phone
    numbers. Each keeps its punctuation, letter classes, country or network prefix and check
    digits; what fails its check stays as it is. E-mail addresses come out in lower case. A
    null text stays null with no values. For null and repeated ids see ``one_per_id``.
    """
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kind = kept.schema["id"].dataType.simpleString()
    found = kept.mapInArrow(_worker(key), f"id {kind}, text string, " + ", ".join(f"{k} long" for k in KINDS))
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return found.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *[F.col(k).alias(f"n_{k}") for k in KINDS], total.alias("n_values"))
