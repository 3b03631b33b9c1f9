"""Operator 7, format-preserving Feistel pseudonyms for personal data.

Values are found by shape and validated (checksums, number ranges, the calendar); each is ranked in the set of all
values of its format, the rank goes through a keyed Feistel permutation of exactly that set (cycle walking), and the
result is written in the same format. Equal values therefore have equal pseudonyms in every document, and different
values different ones, without any shared table: one scan, no shuffle, nothing gathered.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Shapes by kind; where two match, the earlier start wins, then the earlier kind.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?:(?<![0-9A-Za-z])\+1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|(?<![0-9A-Za-z+.-])[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Kinds whose shape may run on into the next tokens: what separates these, and the fewest characters of a value.
RUNS_ON = {"iban": (" ", 15), "card": (" -", 13)}
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
KINDS = tuple(SHAPES)
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHAPES.items()))


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 (or its inverse)."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    name = f"{tweak}:{size}".encode()

    def f(r: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes((half + 7) // 8, "big") + bytes([r]) + name, key=key[:64], digest_size=min(64, half // 8 + 9))
        return int.from_bytes(h.digest(), "big") & mask if half <= 440 else int.from_bytes(hashlib.shake_256(h.digest()).digest(half // 8 + 1), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in range(ROUNDS - 1, -1, -1):
                left, right = right ^ f(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ f(r, right)
        value = left << half | right
        if value < size:
            return value


def _charwise(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters stay letters of their case, digits digits, all else stays."""
    radix = [10 if c in "0123456789" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
    base = ["0" if r == 10 else "a" if "a" <= c <= "z" else "A" for c, r in zip(text, radix, strict=True)]
    value, size = 0, 1
    for c, r, b in zip(text, radix, base, strict=True):
        value, size = value * r + (ord(c) - ord(b) if r > 1 else 0), size * r
    value = permuted(value, size, key, tweak + "".join("d" if r == 10 else "l" if b == "a" else "u" if r > 1 else c for c, r, b in zip(text, radix, base, strict=True)), back)
    out = []
    for c, r, b in zip(reversed(text), reversed(radix), reversed(base), strict=True):
        out.append(chr(ord(b) + value % r) if r > 1 else c)
        value //= r
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check sum of all digits modulo 10; 0 if valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(shape: str, chars: str) -> str:
    """Puts chars into the alphanumeric places of a shape."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(text, key, back):
    digits = re.sub("[^0-9]", "", text)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    while True:
        digits = str(permuted(int(digits[:-1]), 10**n, key, "card", back)).zfill(n)
        digits += str(-luhn(digits + "0") % 10)
        if len(set(digits)) > 1:  # numbers of one digit are not taken for cards
            return _refill(text, digits)


def _iban(text, key, back):
    plain = text.replace(" ", "")
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(plain) <= 34 or check(plain) != 1:
        return None
    body = _charwise(plain[4:], key, "iban" + plain[:2], back)
    return _refill(text, f"{plain[:2]}{98 - check(plain[:2] + '00' + body):02d}{body}")


def _walk(value: int, size: int, key: bytes, tweak: str, back: bool, inside) -> int:
    """The permutation of those of 0..size-1 that are ``inside``: applied until one of them comes up."""
    while True:
        value = permuted(value, size, key, tweak, back)
        if inside(value):
            return value


def _date(text, key, back):
    """Dates of one way of writing are permuted among themselves: the order of the parts and the width of day and month
    stay, a part of one digit gets one digit again."""
    parts = re.split("[-/.]", text)
    orders = [(0, 1, 2)] if "-" in text else [(2, 1, 0)] if "." in text else [(2, 0, 1), (2, 1, 0)]
    for order in orders:
        y, m, d = (int(parts[i]) for i in order)
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        short_month, short_day = (len(parts[i]) == 1 for i in order[1:])
        # day first is only read where the month cannot be; keep it so
        late = len(orders) == 2 and order == (2, 1, 0)

        def inside(n, short_month=short_month, short_day=short_day, late=late):
            new = datetime.date.fromordinal(FIRST_DAY + n)
            return not (short_month and new.month > 9 or short_day and new.day > 9 or late and new.day <= 12)

        new = datetime.date.fromordinal(FIRST_DAY + _walk(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, f"date{order}{short_month}{short_day}", back, inside))
        out = [""] * 3
        for place, value in zip(order, (new.year, new.month, new.day), strict=True):
            out[place] = str(value).zfill(len(parts[place]))
        return ("-" if "-" in text else "." if "." in text else "/").join(out)
    return None


def _ip(text, key, back):
    """Four numbers without leading zeros, or, if one has any, four of the same widths of which one has some again."""
    parts = text.split(".")
    if max(map(int, parts)) > 255:
        return None
    padded = lambda ps: any(len(p) > 1 and p[0] == "0" for p in ps)
    if not padded(parts):
        value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    sizes = [min(256, 10 ** len(p)) for p in parts]

    def written(n):
        out = []
        for p, size in zip(reversed(parts), reversed(sizes), strict=True):
            out.append(str(n % size).zfill(len(p)))
            n //= size
        return out[::-1]

    rank = 0
    for p, size in zip(parts, sizes, strict=True):
        rank = rank * size + int(p)
    total = sizes[0] * sizes[1] * sizes[2] * sizes[3]
    return ".".join(written(_walk(rank, total, key, "ip" + ".".join(str(len(p)) for p in parts), back, lambda n: padded(written(n)))))


def _ssn(text, key, back):
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = permuted(rank, 898 * 99 * 9999, key, "ssn", back)
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text, key, back):
    """Ten digits, not all alike, of which neither area nor exchange is 000. No numbering plan is asked: invented numbers
    are taken for personal data too."""
    digits = re.sub("[^0-9]", "", text)
    country, local = digits[:-10], digits[-10:]
    inside = lambda n: (s := str(n).zfill(10))[:3] != "000" != s[3:6] and len(set(s)) > 1
    if not inside(int(local)):
        return None
    return _refill(text, country + str(_walk(int(local), 10**10, key, "phone", back, inside)).zfill(10))


def _email(text, key, back):
    local, _, domain = text.partition("@")
    return f"{_charwise(local, key, 'email', back)}@{domain}"


MAKE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value (or, ``back``, the value of a pseudonym); None if the text is not a valid value."""
    return MAKE[kind](text, key, back)


def _ends(kind: str, text: str):
    """Where a value of this shape may end, the longest first: a card number or IBAN may be followed by a date, an amount or a
    word that the shape takes for more of it."""
    yield len(text)
    between, least = RUNS_ON.get(kind, ("", 0))
    for end in range(len(text) - 1, 0, -1) if between else ():
        n = end - sum(text.count(c, 0, end) for c in between)
        if text[end] in between and n >= least and (kind != "iban" or n == IBAN_LENGTH.get(text[:2], n)):
            yield end


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with pseudonyms, spans in the original text). A shape that fails validation is tried with
    shorter ends, then as the next kind."""
    out, spans, last, at = [], [], 0, 0
    while m := ANY.search(text, at):
        for kind in KINDS[KINDS.index(m.lastgroup) :]:
            n = m if kind == m.lastgroup else re.compile(SHAPES[kind]).match(text, m.start())
            new, end = next(((p, e) for e in _ends(kind, n[0]) if (p := pseudonym(kind, n[0][:e], key)) is not None), (None, 0)) if n else (None, 0)
            if new is not None:
                out += [text[last : n.start()], new]
                spans.append((n.start(), n.start() + end, kind))
                last = at = n.start() + end
                break
        else:
            at = m.start() + 1
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():  # not inside the same number
                at += 1
    out.append(text[last:])
    return "".join(out), spans


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_<kind> for each kind, spans): texts with all validated values replaced.

    Null text stays null, without values; empty texts stay empty. Rows of equal or null doc_id stand for themselves.
    An empty table gives no rows. Other columns are ignored. Equal values get equal pseudonyms under one key, which is the
    caller's secret. ``spans`` are (start, end, kind) in code points of the original text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    names = ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"]

    def run(batches):
        for b in batches:
            texts, found = [], []
            for t in b.column("text").to_pylist():
                new, spans = replace(t, key) if t else (t, [])
                texts.append(new)
                found.append(spans)
            counts = [pa.array([sum(k == kind for *_, k in s) for s in found], pa.int64()) for kind in KINDS]
            told = pa.array([[{"start": a, "end": z, "kind": k} for a, z, k in s] for s in found], span)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *counts, told], names)

    return rows.mapInArrow(tidied(run), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans array<struct<start:long,end:long,kind:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    """The key is the session's setting ``tessera.pii.key``; where there is none, as in tests, one that is no secret."""
    key = spark.conf.get("tessera.pii.key", "not a secret")
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key.encode())
