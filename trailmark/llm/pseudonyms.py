"""Format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers, social security numbers, bank account numbers (IBAN), phone
numbers, addresses (IPv4 and e-mail) and dates are found by patterns and
validated.  The value of each is a number in a domain of exactly the valid
values of its format, on which a Feistel network with a keyed hash as round
function, walked in cycles until it is back in the domain, is a permutation.
Bank account numbers and local parts, whose letters and digits are free, are
vectors of digits of base 10 and 26; a Feistel network adds the hash of each
half to all digits of the other one, in time that is linear in their length.
So a pseudonym is valid and looks as the original did, equal values (whatever
their separators) have equal pseudonyms in all documents, and different values
have different ones.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import table, without

#: For tests and the query; a caller gives a secret one.
KEY = b"pseudonyms-1"
ROUNDS = 8
KINDS = ("card", "ssn", "iban", "phone", "ip", "email", "date")
_FIRST, _LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
_MONTHS = "January February March April May June July August September October November December".split()

#: Characters of the IBAN of each country that has a fixed format.
_IBAN_LENGTHS = {c: int(n) for n, some in (x.split(":") for x in "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split()) for c in some.split(",")}

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}(?P<sep>[-/.])[0-9]{1,2}(?P=sep)[0-9]{1,2}|[0-9]{1,2}(?P<sep2>[-/.])[0-9]{1,2}(?P=sep2)[0-9]{4}|[0-9]{1,2} (?:" + "|".join(_MONTHS) + r") [0-9]{4})(?![0-9]|[./-][0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<sep3>[ -])[0-9]{4}(?P=sep3)[0-9]{4}(?P=sep3)[0-9]{1,7}|[0-9]{4}(?P<sep4>[ -])[0-9]{6}(?P=sep4)[0-9]{5})(?![0-9]))"
)


class Permuter:
    """Permutations of ``range(n)``, one for each key, name and n, and of vectors of digits."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key[:64], rounds

    def _round(self, name: str, i: int, half: bytes, size: int) -> bytes:
        """``size`` bytes that depend on key, name, round and all of ``half``."""
        seed = hashlib.blake2b(f"{name}|{i}|".encode() + half, key=self.key).digest()
        return seed[:size] if size <= len(seed) else hashlib.shake_256(seed).digest(size)

    def __call__(self, value: int, n: int, name: str) -> int:
        """``value`` of ``range(n)``, n at most 2**128."""
        if n <= 1:
            return value
        a = max(2, int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() // 2))
        b = -(-n // a)
        name = f"{name}|{n}"
        hashed = lambda i, half: int.from_bytes(self._round(name, i, b"%d" % half, 24), "big")
        while True:  # at most n < a * b values, nearly all of them within range(n)
            left, right = divmod(value, b)
            for i in range(0, self.rounds, 2):
                left = (left + hashed(i, right)) % a
                right = (right + hashed(i + 1, left)) % b
            value = left * b + right
            if value < n:
                return value

    def digits(self, value: list[int], bases: list[int], name: str) -> list[int]:
        """A vector of digits, each below the base of its place."""
        base = np.array(bases, np.uint32)
        at = len(bases) // 2
        halves, sizes = [np.array(value[:at], np.uint32), np.array(value[at:], np.uint32)], (base[:at], base[at:])
        name = f"{name}|{len(bases)}"
        for i in range(self.rounds):
            k = i % 2
            other = halves[1 - k].astype(np.uint8).tobytes()
            noise = np.frombuffer(self._round(name, i, other, 4 * len(sizes[k])), "<u4")
            halves[k] = (halves[k] + noise % sizes[k]) % sizes[k]
        return np.concatenate(halves).tolist()


def _luhn(digits: str) -> int:
    """The check digit that ``digits`` lack."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, values: str) -> str:
    """``shape`` with its letters and digits replaced, in order, by ``values``."""
    it = iter(values)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def card(text: str, permute: Permuter) -> str | None:
    digits = re.sub("[ -]", "", text)
    if digits[0] == "0" or _luhn(digits[:-1]) != int(digits[-1]):
        return None
    # the first digit names the network and stays; the last one checks the rest
    n = len(digits) - 2
    body = digits[0] + str(permute(int(digits[1:-1]), 10**n, f"card{digits[0]}")).zfill(n)
    return _refill(text, body + str(_luhn(body)))


def ssn(text: str, permute: Permuter) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    value = permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def iban(text: str, permute: Permuter) -> str | None:
    bare = text.replace(" ", "")
    country, check, body = bare[:2], bare[2:4], bare[4:]
    if not 15 <= len(bare) <= 34 or len(bare) != _IBAN_LENGTHS.get(country, len(bare)) or int(check) != _iban_check(country, body):
        return None
    # digits stay digits and letters stay letters
    bases = [10 if c.isdigit() else 26 for c in body]
    new = permute.digits([int(c) if c.isdigit() else ord(c) - 65 for c in body], bases, "iban" + country + "".join("0" if x == 10 else "A" for x in bases))
    body = "".join(str(d) if x == 10 else chr(65 + d) for d, x in zip(new, bases, strict=True))
    return _refill(text, f"{country}{_iban_check(country, body):02d}{body}")


def iban_ends(text: str) -> list[int]:
    """Where an IBAN at the beginning of a match may end: before a blank or at its end, the longest first."""
    return [len(text), *(m.start() for m in reversed([*re.finditer(" ", text)]))]


def phone(text: str, permute: Permuter) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    prefix, own = digits[:-10], digits[-10:]
    # area and exchange begin with 2 to 9
    value = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 800 + (int(own[3]) - 2) * 100 + int(own[4:6])
    value = permute(value * 10000 + int(own[6:]), 800 * 800 * 10000, "phone")
    value, line = divmod(value, 10000)
    area, exchange = divmod(value, 800)
    return _refill(text, f"{prefix}{area + 200}{exchange + 200}{line:04d}")


def ip(text: str, permute: Permuter) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return str(ipaddress.IPv4Address(permute(int(ipaddress.IPv4Address(text)), 1 << 32, "ip")))


def email(text: str, permute: Permuter) -> str | None:
    """The local part, of letters and digits as before; the domain stays."""
    local, domain = text.rsplit("@", 1)
    free = [c for c in local.lower() if c.isalnum()]
    bases = [10 if c.isdigit() else 26 for c in free]
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", local.lower()))
    new = permute.digits([int(c) if c.isdigit() else ord(c) - 97 for c in free], bases, f"email{shape}@{domain.lower()}")
    out = iter([str(d) if x == 10 else chr(97 + d) for d, x in zip(new, bases, strict=True)])
    return "".join((x.upper() if c.isupper() else x) if c.isalnum() and (x := next(out)) else c for c in local) + "@" + domain


def date(text: str, permute: Permuter) -> str | None:
    """A day of 1900 to 2099, in the same notation; day before month unless only the reverse is valid.

    Days above the 12th and the others are permuted among themselves, so that a
    pseudonym with the month first is read as that date as well.
    """
    try:
        if " " in text:
            d, month, y = text.split(" ")
            day = datetime.date(int(y), _MONTHS.index(month) + 1, int(d))
            show = lambda x: f"{x.day} {_MONTHS[x.month - 1]} {x.year}"
        else:
            sep = re.search("[-/.]", text)[0]
            parts = text.split(sep)
            pad = [len(p) > 1 and p[0] == "0" or len(p) == 4 or int(p) > 9 for p in parts]
            two = (lambda x, i: f"{x:02d}") if all(pad) else (lambda x, i: str(x))
            if len(parts[0]) == 4:
                day = datetime.date(*map(int, parts))
                show = lambda x: sep.join((f"{x.year}", two(x.month, 1), two(x.day, 2)))
            else:
                a, b, y = map(int, parts)
                day = datetime.date(y, b, a) if b <= 12 else datetime.date(y, a, b)
                show = lambda x: sep.join((*((two(x.day, 0), two(x.month, 1)) if b <= 12 else (two(x.month, 0), two(x.day, 1))), f"{x.year}"))
    except ValueError:
        return None
    at = (day - _FIRST).days
    if not 0 <= at <= (_LAST - _FIRST).days:
        return None
    while True:
        at = permute(at, (_LAST - _FIRST).days + 1, "date")
        new = _FIRST + datetime.timedelta(at)
        if (new.day > 12) == (day.day > 12):
            return show(new)


_MAKE: dict[str, Callable[[str, Permuter], str | None]] = {"card": card, "ssn": ssn, "iban": iban, "phone": phone, "ip": ip, "email": email, "date": date}


class Replacer:
    """Replaces what it finds in texts and counts it by kind."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        permute = Permuter(key)
        self.kinds = kinds
        cached = lru_cache(1 << 16)(lambda kind, value: _MAKE[kind](value, permute))
        # long values are not kept
        self.one = lambda kind, value: cached(kind, value) if len(value) < 256 else _MAKE[kind](value, permute)

    def __call__(self, text: str) -> tuple[str, list[int]]:
        counts = [0] * len(KINDS)
        out, at = [], 0
        pos = 0
        while (m := PATTERN.search(text, pos)) is not None:
            kind = m.lastgroup if m.lastgroup in _MAKE else next(k for k in KINDS if m[k])
            new, end = None, m.end()
            if kind in self.kinds:
                for n in iban_ends(m[0]) if kind == "iban" else [len(m[0])]:
                    new, end = self.one(kind, m[0][:n]), m.start() + n
                    if new is not None:
                        break
            # what isn't valid may still hold something that begins later
            pos = end if new is not None else m.start() + 1
            if new is not None:
                counts[KINDS.index(kind)] += 1
                out += [text[at : m.start()], new]
                at = end
        return "".join([*out, text[at:]]) if out else text, counts


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``_pii``: map<kind, number found>, kinds that were found only.

    Null and empty texts stay as they are, and an empty table stays empty.  Texts
    and what is found in them may have any length.  Rows are treated one by one,
    repeated rows alike, and all other columns stay, whatever their names; a
    column ``_pii`` is replaced.  ``key`` has up to 64 bytes.
    """
    docs = without(docs, "_pii")
    at = docs.columns.index(text_col)
    kind_of = docs.schema.fields[at].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Replacer(key, kinds)
        for batch in batches:
            texts, found = [], []
            for text in batch.column(at):
                text = text.as_py()
                new, counts = replace(text) if text else (text, [])
                texts.append(new)
                found.append([(k, n) for k, n in zip(KINDS, counts) if n])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch([*columns, pa.array(found, pa.map_(pa.string(), pa.int64()))], names=[*batch.schema.names, "_pii"])

    fields = [*docs.schema.fields[:at], T.StructField(text_col, kind_of), *docs.schema.fields[at + 1 :]]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("_pii", T.MapType(T.StringType(), T.LongType()))]))


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", *[F.coalesce(F.col("_pii")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
