"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by form and validated (check digits, number plans, calendar). Each kind has one canonical value whatever
its spelling: the digits of a card, ten digits of the North American plan, a day, an address as a number, a local part in
lower case. That value is permuted within its kind by one keyed Feistel network and written in the spelling found, so
equal values get equal pseudonyms in all documents and in all spellings listed below; separators, widths and case stay. Steps that
leave the valid values are taken again (cycle walking), so the permutation stays one-to-one on valid values. With the key,
``pseudonymise(..., inverse=True)`` restores a text.

Kinds: payment cards (Luhn; first digit and length stay), telephone numbers (ten digits of the North American plan, with or
without a 1 in front or separators; others with a plus sign keep their first two digits, and a trunk zero in brackets is no part
of them), IPv4 and IPv6 addresses, social
security numbers, IBANs (mod 97; country and character classes stay), e-mail addresses (character classes of the local part;
the domain stays) and dates with a four-digit year from 1900 to 2099 (year, month, day; day, month, year; or month, day,
year, where that alone is a date; whether day and month have one digit and the day exceeds 12 stays, so every spelling
can be written and read again).

A card is found within a run of digits if it stands there in one block or in groups of 4-4-4-4, 4-4-4-4-3, 4-6-5 or 4-6-4
digits; other groupings of three digits or more are taken if the whole run is a card. Where 19 digits in groups begin with 16 that are a card, these
are taken. An IPv6 address that is neither shortened as usual nor written in full comes back in the usual short form.

Defined results: null text stays null; texts without a valid value stay as they are; repeated rows give a row each; an
empty table gives an empty result; other columns are kept, and one named as the count of replaced values is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: For tests and examples. Production passes a secret of its own.
EXAMPLE_KEY = b"an example key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

_IN_GROUPS = r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19}"
#: Each form by itself, in the order in which they are tried.
_EACH = {
    name: re.compile(pattern)
    for name, pattern in {
        "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:))(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}(?![\w:]|\.[0-9])",
        "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
        "ymd": r"(?<![\w./-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![\w]|[-/.][0-9])",
        "dmy": r"(?<![\w./-])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![\w]|[-/.][0-9])",
        "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9])",
        "nanp": r"(?<![\w])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w]|[.-][0-9])",
        "phone": r"(?<![\w])\+(?:1(?:[ ().-]{0,2}[0-9]){10}|[1-9](?:[ ().-]{0,2}[0-9]){7,14})(?![\w])",
        "bare": r"(?<![\w.,+-])1?[0-9]{10}(?![\w]|[.,-][0-9])",
        "card": rf"(?<![\w.])(?:{_IN_GROUPS})(?![\w])",
        "run": r"(?<![\w.])(?<![0-9][ -])(?=(?:[ -]?[0-9]){13,19}(?![ -]?[0-9]|\w))[0-9]{3,}(?:([ -])[0-9]{3,}(?:\1[0-9]{3,})*)(?![ -]?[0-9]|\w)",
    }.items()
}
#: Every value holds one of these; where a form may begin in the words around.
_SIGN = re.compile("[0-9@]|::")
_BEGIN = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}|(?<![\w:.])(?:[A-Fa-f][0-9A-Fa-f]{0,3}:|::)|(?<!\w)[(+]?[0-9]")
_DIGIT = re.compile("[0-9]")
_GAP = re.compile("[\\x20\\x09-\\x0D]")
#: Where no white space follows, a value around a sign is looked for in so many characters behind it: more than any form has.
_FAR = 1000
#: Fewest characters of a value, but for IPv6 addresses.
_SHORTEST = 6


def luhn_digit(body: str) -> int:
    """The check digit that makes ``body`` valid."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _feistel(x: int, half: int, tweak: bytes, key: bytes, inverse: bool) -> int:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    size = -(-half // 8)
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        side = left if inverse else right
        f = hashlib.blake2b(tweak + bytes([r]) + side.to_bytes(size, "big"), key=key, digest_size=max(size, 8)).digest()
        f = int.from_bytes(f, "big") & mask
        left, right = (right ^ f, left) if inverse else (right, left ^ f)
    return left << half | right


def permute(x: int, size: int, tweak: bytes, key: bytes, inverse: bool = False, valid: Callable[[int], bool] | None = None) -> int:
    """Image of ``x`` under the keyed permutation of the valid numbers below ``size``."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        x = _feistel(x, half, tweak, key, inverse)
        if x < size and (valid is None or valid(x)):
            return x


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    rest = iter(digits)
    return _DIGIT.sub(lambda _: next(rest), text)


def _classes(text: str) -> list[tuple[str, int]]:
    """(first of its class, size) for the letters and digits of ``text``."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(("0", 10))
        elif "a" <= c <= "z":
            out.append(("a", 26))
        elif "A" <= c <= "Z":
            out.append(("A", 26))
    return out


def _in_classes(text: str, tweak: bytes, key: bytes, inverse: bool) -> str:
    """Permutes letters and digits within their classes; other characters stay."""
    classes = _classes(text)
    own = [c for c in text if "0" <= c <= "9" or "a" <= c <= "z" or "A" <= c <= "Z"]
    x, size = 0, 1
    for c, (first, n) in zip(own, classes, strict=True):
        x, size = x * n + ord(c) - ord(first), size * n
    x = permute(x, size, tweak + "".join(f for f, _ in classes).encode(), key, inverse)
    new = []
    for first, n in reversed(classes):
        x, d = divmod(x, n)
        new.append(chr(ord(first) + d))
    rest = iter(reversed(new))
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in text)


def _is_card(d: str) -> bool:
    return luhn_digit(d[:-1]) == int(d[-1]) and len(set(d[:-1])) > 1


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(text)
    if not _is_card(d):
        return None
    n = len(d) - 2

    def whole(x: int) -> str:
        body = d[0] + f"{x:0{n}d}"
        return body + str(luhn_digit(body))

    def valid(x: int) -> bool:
        new = whole(x)
        return len(set(new[:-1])) > 1 and (len(d) != 19 or _is_card(new[:16]) == _is_card(d[:16]))

    return _refill(text, whole(permute(int(d[1:-1]), 10**n, b"card%d" % len(d), key, inverse, valid)))


_THREE_MORE = re.compile(r"[ -][0-9]{3}(?!\w)")


def _card_at(text: str, at: int, key: bytes, inverse: bool) -> tuple[int, int, str] | None:
    """(start, end, pseudonym) of a card in one block or in groups that begins at ``at``."""
    if m := _EACH["card"].match(text, at):
        if new := pseudonym("card", m[0], key, inverse):
            return at, m.end(), new
        more = _THREE_MORE.match(text, m.end())
        if more and m[1] == more[0][0] and (new := pseudonym("card", text[at : more.end()], key, inverse)):
            return at, more.end(), new
    return None


_GROUPED = re.compile(rf"(?<![0-9])(?:{_IN_GROUPS})(?![0-9])")


def _run(text: str, key: bytes, inverse: bool) -> str | None:
    """A whole run of digits in other groups."""
    return None if _GROUPED.search(text) else _card(text, key, inverse)


def _in_plan(d: str) -> bool:
    """Whether ten digits are a number of the North American plan."""
    return d[0] > "1" and d[3] > "1" and d[1:3] != "11" and d[4:6] != "11"


def _nanp(text: str, key: bytes, inverse: bool) -> str | None:
    """Numbers that are none of the plan stay, but with a plus sign they are telephone numbers like others."""
    d = _digits(text)
    lead, d = d[:-10], d[-10:]
    if not _in_plan(d) or lead not in ("", "1"):
        return _phone(text, key, inverse) if text[0] == "+" else None
    new = permute(int(d), 10**10, b"nanp", key, inverse, lambda x: _in_plan(f"{x:010d}"))
    return _refill(text, lead + f"{new:010d}")


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    if "(0)" in text:  # a trunk zero, which is not part of the number
        new = _phone(text.replace("(0)", "()", 1), key, inverse)
        return new and new.replace("()", "(0)", 1)
    d = _digits(text)
    n, valid = len(d) - 2, None
    if len(d) == 11 and d[0] == "1":
        if _in_plan(d[1:]):
            return _nanp(text, key, inverse)
        valid = lambda x: not _in_plan(d[1] + f"{x:0{n}d}")
    return _refill(text, d[:2] + f"{permute(int(d[2:]), 10**n, b'phone' + d[:2].encode(), key, inverse, valid):0{n}d}")


def _ip6(text: str, key: bytes, inverse: bool) -> str | None:
    try:
        own = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    # the unspecified address and loopback, and what may be a name of a programming language
    if int(own) < 1 << 16 or ("::" in text and len(text.partition(":")[0]) < 4):
        return None
    new = ipaddress.IPv6Address(permute(int(own), 1 << 128, b"ip6", key, inverse, lambda x: x >= 1 << 16))
    out = new.exploded if text.lower() == own.exploded != own.compressed else new.compressed
    return out.upper() if text != text.lower() else out


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts) or not 0 < int(parts[0]) < 224:
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    x = permute(x, 1 << 32, b"ip", key, inverse, lambda v: 0 < v >> 24 < 224)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    d = _digits(text)
    if not ok(d):
        return None
    return _refill(text, f"{permute(int(d), 10**9, b'ssn', key, inverse, lambda x: ok(f'{x:09d}')):09d}")


def _mod97(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _mod97(compact) != 1:
        return None
    body = _in_classes(compact[4:], b"iban" + compact[:2].encode(), key, inverse)
    check = 98 - _mod97(compact[:2] + "00" + body)
    rest = iter(compact[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(rest) for c in text)


def _email(text: str, key: bytes, inverse: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    new = _in_classes(local.lower(), b"email" + domain.lower().encode(), key, inverse)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, local, strict=True)) + "@" + domain


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        out = datetime.date(year, month, day)
    except ValueError:
        return None
    return out if FIRST_DAY <= out <= LAST_DAY else None


def _shifted(day: datetime.date, key: bytes, inverse: bool) -> datetime.date:
    """The pseudonym of a day, of the same kind: numbers of digits, and whether the day exceeds the months."""
    kind = lambda d: (d.day > 9, d.day > 12, d.month > 9)
    n = (LAST_DAY - FIRST_DAY).days + 1
    valid = lambda x: kind(FIRST_DAY + datetime.timedelta(x)) == kind(day)
    return FIRST_DAY + datetime.timedelta(permute((day - FIRST_DAY).days, n, b"date", key, inverse, valid))


def _ymd(text: str, key: bytes, inverse: bool) -> str | None:
    sep = text[4]
    y, m, d = text.split(sep)
    day = _day(int(y), int(m), int(d))
    if not day:
        return None
    new = _shifted(day, key, inverse)
    return f"{new.year}{sep}{new.month:0{len(m)}d}{sep}{new.day:0{len(d)}d}"


def _dmy(text: str, key: bytes, inverse: bool) -> str | None:
    """Day first where that is a date, else month first."""
    sep = text[1] if not text[1].isdigit() else text[2]
    a, b, y = text.split(sep)
    if day := _day(int(y), int(b), int(a)):
        new = _shifted(day, key, inverse)
        parts = new.day, new.month
    elif day := _day(int(y), int(a), int(b)):
        new = _shifted(day, key, inverse)
        parts = new.month, new.day
    else:
        return None
    return f"{parts[0]:0{len(a)}d}{sep}{parts[1]:0{len(b)}d}{sep}{new.year}"


_BY_FORM = {
    "email": _email, "iban": _iban, "ip6": _ip6, "ip": _ip, "ymd": _ymd, "dmy": _dmy, "ssn": _ssn, "nanp": _nanp, "phone": _phone,
    "bare": _nanp, "card": _card, "run": _run,
}


@lru_cache(maxsize=100_000)
def pseudonym(form: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a value of a form; None if the value isn't valid."""
    return _BY_FORM[form](value, key, inverse)


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, int]:
    """(text with pseudonyms, how many)."""
    out, n, done, at = [], 0, 0, 0
    while sign := _SIGN.search(text, at):
        # from the white space before the sign to that behind it
        first = max(at, *(text.rfind(c, at, sign.start()) + 1 for c in " \n\t"))
        gap = _GAP.search(text, sign.start(), sign.start() + _FAR)
        last = gap.start() if gap else min(len(text), sign.start() + _FAR)
        if last - first < _SHORTEST and gap and gap[0] != " " and text.find("::", first, last) < 0:
            at = last  # no form has other white space inside, nor so few characters
            continue
        m = _BEGIN.search(text, first, last)
        if not m:
            at = last
            continue
        found, begin = None, m.start()
        for form, pattern in _EACH.items():
            if form == "card":
                found = _card_at(text, begin, key, inverse)
            elif one := pattern.match(text, begin):
                new = pseudonym(form, one[0], key, inverse)
                found = None if new is None else (begin, one.end(), new)
            if found:
                break
        if found:
            begin, at, new = found
            out += [text[done:begin], new]
            n, done = n + 1, at
        else:
            at = begin + 1
    return "".join([*out, text[done:]]), n


def pseudonymise_texts(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_found", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and the number of values as ``count_col``. Of texts of more than about
    200 KB on average, take fewer at a time (``common.batch_rows`` around what is executed)."""

    @F.arrow_udf("text string, n long")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), 500):
            out = [(None, 0) if t is None else pseudonymise(t, key, inverse) for t in texts.slice(at, 500).to_pylist()]
            parts.append(pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["text", "n"]))
        common.give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("n", pa.int64())]))

    keep = [c for c in docs.columns if c != count_col]
    (both,) = common.unused(docs, "_both")
    out = docs.select(*keep, run(F.col(text_col).cast("string")).alias(both))
    return out.select(*[F.col(f"{both}.text").alias(c) if c == text_col else c for c in keep], F.col(f"{both}.n").alias(count_col))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return common.written(pseudonymise_texts(docs, EXAMPLE_KEY), "pseudonyms")
