"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Found values are validated (check digits, number plans, calendars) and then permuted within the set of all
values of their format: a card number becomes another one with the same first digit and a right check
digit, a date another date, an address another one of the same shape. The permutation depends on the key and
the format only, so equal values stay equal across all documents, different ones stay different, and whoever
has the key can turn them back. What is not valid is left as it is; shorter spans and other starts within it
are tried. Where a span that failed would become valid beside the pseudonym, the permutation goes on until it
does not, so that the way back finds the same spans; only there may a value get another pseudonym than elsewhere.

A null text stays null, an empty one empty. Texts are treated whole, row by row; repeated rows get equal
results and an empty table an empty one. Other columns are kept as they are; columns that carry the name of
a count are replaced. Separators and letter case are part of the format, not of the value.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import isqrt, prod
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import map_rows, query, table

ROUNDS = 10


class Feistel:
    """Keyed permutations of range(size), one for each (tweak, size)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, tweak: str, size: int, turn: int, half: int) -> int:
        width = (size.bit_length() + 7) // 8 + 8
        data = f"{tweak}|{size}|{turn}|{half}".encode()
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(data + b"|%d" % len(out), key=self.key).digest()
        return int.from_bytes(out[:width], "big")

    def once(self, x: int, size: int, tweak: str, back: bool) -> int:
        """On the rectangle of about isqrt(size) rows that holds range(size)."""
        a = isqrt(max(1, size) - 1) + 1
        b = -(-size // a)
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            move = self.number(tweak, size, turn, left if turn % 2 else right)
            move = -move if back else move
            if turn % 2:
                right = (right + move) % b
            else:
                left = (left + move) % a
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """x goes on through the permutation until it is in range and valid again; x itself has to be."""
        if size < 2:
            return x
        while True:
            x = self.once(x, size, tweak, back)
            if x < size and valid(x):
                return x


class Still(Feistel):
    """Leaves all values as they are: tells what is valid without the cost of a permutation."""

    def __init__(self):
        pass

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        return x


STILL = Still()


# numbers with a format

DIGITS, LOWER, HEX, BASE36 = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_number(symbols: list[int], radices: list[int]) -> int:
    out = 0
    for s, r in zip(symbols, radices):
        out = out * r + s
    return out


def to_symbols(number: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        number, s = divmod(number, r)
        out.append(s)
    return out[::-1]


def permute_letters(text: str, net: Feistel, tweak: str, back: bool, alphabet: str | None = None) -> str:
    """All ASCII letters and digits of a text within their kind, or within one alphabet; the case stays."""
    places, symbols, sets = [], [], []
    for at, c in enumerate(text):
        own = alphabet if alphabet else DIGITS if c in DIGITS else LOWER
        k = own.find(c if c in own else c.lower())
        if k >= 0:
            places.append(at)
            symbols.append(k)
            sets.append(own)
    radices = [len(s) for s in sets]
    shape = "".join("9" if s is DIGITS else "a" for s in sets)
    new = to_symbols(net.permute(to_number(symbols, radices), prod(radices), f"{tweak}|{shape}", back=back), radices)
    out = list(text)
    for at, k, own in zip(places, new, sets):
        out[at] = own[k].upper() if text[at].isupper() else own[k]
    return "".join(out)


def with_digits(text: str, digits: str) -> str:
    """The text with its digits replaced in order; everything else stays."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_digit(payload: str) -> str:
    total = 0
    for at, c in enumerate(reversed(payload)):
        d = int(c) * (2 - at % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def card(text: str, net: Feistel, back: bool) -> str | None:
    """13 to 19 digits with a right check digit. The first digit stays, the check digit follows."""
    digits = digits_of(text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    inner = digits[1:-1]
    new = net.permute(int(inner), 10 ** len(inner), f"card|{len(digits)}|{digits[0]}", back=back)
    payload = digits[0] + str(new).zfill(len(inner))
    return with_digits(text, payload + luhn_digit(payload))


def nanp_valid(number: int) -> bool:
    digits = str(number).zfill(10)
    return len(digits) == 10 and digits[0] >= "2" and digits[3] >= "2"


def phone(text: str, net: Feistel, back: bool) -> str | None:
    """Ten digits of the North American plan, with or without +1; area and exchange start with 2 to 9. Others go too
    if +1 or brackets tell that a phone is meant, and stay outside of the plan."""
    digits = digits_of(text)
    number = int(digits[-10:])
    if nanp_valid(number):
        new = net.permute(number, 10**10, "phone", nanp_valid, back)
    elif "(" in text or text[0] == "+":
        new = net.permute(number, 10**10, "phone outside", lambda n: not nanp_valid(n), back)
    else:
        return None
    return with_digits(text, digits[:-10] + str(new).zfill(10))


def phone_abroad(text: str, net: Feistel, back: bool) -> str | None:
    """8 to 15 digits after a plus; the first two, where the country is, stay."""
    digits = digits_of(text)
    if not 8 <= len(digits) <= 15:
        return None
    rest = digits[2:]
    return with_digits(text, digits[:2] + str(net.permute(int(rest), 10 ** len(rest), f"abroad|{digits[:2]}|{len(rest)}", back=back)).zfill(len(rest)))


def ssn_valid(number: int) -> bool:
    area, group, serial = number // 1_000_000, number // 10_000 % 100, number % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(text: str, net: Feistel, back: bool) -> str | None:
    number = int(digits_of(text))
    if not ssn_valid(number):
        return None
    return with_digits(text, str(net.permute(number, 10**9, "ssn", ssn_valid, back)).zfill(9))


def ip_valid(number: int) -> bool:
    """Neither of this host, nor loopback, nor multicast and beyond."""
    return number >> 24 not in (0, 127) and number >> 24 < 224


def ip(text: str, net: Feistel, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    number = int.from_bytes(bytes(map(int, octets)), "big")
    if not ip_valid(number):
        return None
    return ".".join(map(str, net.permute(number, 1 << 32, "ip", ip_valid, back).to_bytes(4, "big")))


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return str(98 - number % 97).zfill(2)


def iban(text: str, net: Feistel, back: bool) -> str | None:
    """Country, check digits and account; the account's digits and letters are permuted, the check follows."""
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if iban_check(country, rest) != check:
        return None
    rest = permute_letters(rest, net, f"iban|{country}", back)
    new = iter(country + iban_check(country, rest) + rest)
    return "".join(c if c == " " else next(new) for c in text)


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def date(text: str, net: Feistel, back: bool) -> str | None:
    """A calendar date from 1900 to 2099: year-month-day, day.month.year, month/day/year, or, where only that
    can be meant, day/month/year; such dates stay so, with a day beyond 12."""
    sign = next(c for c in text if c in "-./")
    parts = text.split(sign)
    numbers = list(map(int, parts))
    day_first = sign == "." or sign == "/" and numbers[0] > 12
    order = (0, 1, 2) if sign == "-" else (2, 1, 0) if day_first else (2, 0, 1)
    try:
        day = datetime.date(*(numbers[k] for k in order)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    late = sign == "/" and day_first
    valid = (lambda d: datetime.date.fromordinal(d + FIRST_DAY).day > 12) if late else (lambda d: True)
    new = datetime.date.fromordinal(net.permute(day, DAYS, f"date|{late}", valid, back) + FIRST_DAY)
    shown = [0, 0, 0]
    for k, value in zip(order, (new.year, new.month, new.day)):
        shown[k] = value
    padded = all(len(p) >= 2 for p in parts)
    return sign.join(str(v).zfill(2 if padded else 1) for v in shown)


def email(text: str, net: Feistel, back: bool) -> str:
    """Everything before the last dot, letters and digits each within their kind."""
    head, dot, tail = text.rpartition(".")
    return permute_letters(head, net, "email", back) + dot + tail


def access_key(text: str, net: Feistel, back: bool) -> str:
    return text[:4] + permute_letters(text[4:], net, "key", back, BASE36)


def secret(text: str, net: Feistel, back: bool) -> str:
    """A value after password, token or the like: hexadecimal as such, others within the kinds of their letters."""
    return permute_letters(text, net, "secret", back, HEX if all(c in HEX for c in text) else None)


class Kind(NamedTuple):
    name: str
    hint: re.Pattern | str  # without which a text has none
    pattern: re.Pattern  # the value is the last group, or all of the match
    new: Callable[[str, Feistel, bool], str | None]
    spans: Callable[[str, int, int], list[tuple[int, int]]] | None = None  # of a run, in the order they are tried


def groups_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in GROUP.finditer(text, start, end)]


def whole_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of a run of digit groups that are written as cards are: all of the run or of the groups of one size,
    a single group, or 4-4-4-4-3, 4-6-5 and 4-6-4, with one separator. Groups that a point, slash or colon
    ties to other digits, as in 12/25, are none of a card here. Longest first."""
    groups = groups_of(text, start, end)
    if start >= 2 and TIED_BEFORE.match(text, start - 2):
        groups = groups[1:]
    if TIED_AFTER.match(text, end):
        groups = groups[:-1]
    sizes = [e - s for s, e in groups]
    out = []
    for at in range(len(groups)):
        n = 0
        for to in range(at, min(len(groups), at + 19)):
            n += sizes[to]
            if n > 19 or to > at + 1 and text[groups[to - 1][1]] != text[groups[at][1]]:
                break
            shape = tuple(sizes[at : to + 1])
            even = len(set(shape)) == 1 and sizes[at - 1 : at] != [shape[0]] and sizes[to + 1 : to + 2] != [shape[0]]
            if n >= 13 and (even or len(shape) in (1, len(groups)) or shape in SHAPES):
                out.append((-n, groups[at][0], groups[to][1]))
    return [(s, e) for _, s, e in sorted(out)]


def loose_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """All spans of 13 to 19 digits from one group border to another, of six groups at most. Longest first."""
    groups = groups_of(text, start, end)
    out = []
    for at in range(len(groups)):
        n = 0
        for s, e in groups[at : at + 6]:
            n += e - s
            if 13 <= n <= 19:
                out.append((-n, groups[at][0], e))
    return [(s, e) for _, s, e in sorted(out)]


def shorter_spans(text: str, start: int, end: int, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The match, and what is left of it without its last groups, as far as the pattern allows."""
    yield start, end
    for k in range(end - 1, start, -1):
        if text[k - 1].isalnum() and not text[k].isalnum() and pattern.fullmatch(text, start, k):
            yield start, k


DIGIT, GROUP = re.compile("[0-9]"), re.compile("[0-9]+")
TIED_BEFORE, TIED_AFTER = re.compile("[0-9][./:]"), re.compile("[./:][0-9]")
SHAPES = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}
RUN = re.compile(r"(?<![\w-])[0-9]+(?:[ -][0-9]+)*(?![\w-])")
# Earlier kinds win where two meet.
KINDS = (
    Kind("email", "@", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    Kind("access_key", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), access_key),
    Kind("secret", re.compile(r"(?i)passw|secret|token|api.?key"), re.compile(r"""(?i:\b(?:password|passwd|secret|token|api[_-]?key))["']?\s*[=:]\s*["']?([A-Za-z0-9_./+-]{8,}[A-Za-z0-9])"""), secret),
    Kind("iban", DIGIT, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    Kind("ip", DIGIT, re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"), ip),
    Kind("card", DIGIT, RUN, card, whole_spans),
    Kind("phone", DIGIT, re.compile(r"(?<!\w)(?<![0-9][.,])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?!\w|[.,][0-9])|(?<!\w)(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"), phone),
    Kind("phone_abroad", "+", re.compile(r"(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w)"), phone_abroad),
    Kind("ssn", DIGIT, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), ssn),
    Kind("date", DIGIT, re.compile(r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-9]{2})|(?![\w/-]))|(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]))"), date),
)
# Cards grouped in another way give way to the other kinds.
ALL_KINDS = (*KINDS, Kind("card", DIGIT, RUN, card, loose_spans))


def valid_spans(kind: Kind, text: str, taken: bytearray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The spans of a kind that are free and valid, which are taken then, and those that were tried and are not valid."""
    good: list[tuple[int, int]] = []
    bad: list[tuple[int, int]] = []
    at = 0
    while match := kind.pattern.search(text, at):
        start, end = match.span(match.lastindex or 0)
        # the spans of a run are all tried; else another start within the match may do
        at = match.end() if kind.spans or match.lastindex else match.start() + 1
        for s, e in kind.spans(text, start, end) if kind.spans else shorter_spans(text, start, end, kind.pattern):
            if taken.find(1, s, e) >= 0:
                continue
            if kind.new(text[s:e], STILL, False) is None:
                bad.append((s, e))
                continue
            good.append((s, e))
            taken[s:e] = b"\1" * (e - s)
            if not kind.spans:
                at = max(at, e)
                break
    return good, bad


def renewed(text: str, good: list[tuple[int, int, Kind]], bad: list[tuple[int, int, Kind]], net: Feistel, back: bool) -> list[str]:
    """A pseudonym for each span, beside which the spans that failed fail again.

    One after the other, on the way back in the opposite order: so each is permuted beside the same neighbours.
    """
    shown = [text[s:e] for s, e, _ in good]
    meets: list[list[tuple[int, int, Kind]]] = [[] for _ in good]  # failed spans by the values they meet
    ends = [e for _, e, _ in good]
    for span in bad:
        for k in range(bisect_right(ends, span[0]), len(good)):
            if good[k][0] >= span[1]:
                break
            meets[k].append(span)

    def fails(s: int, e: int, kind: Kind) -> bool:
        parts, at = [], s
        for k in range(bisect_right(ends, s), len(good)):
            start, end, _ = good[k]
            if start >= e:
                break
            # within a value, places count from its end, as only what comes first in it may change its length
            first = max(0, len(shown[k]) - (end - s)) if s > start else 0
            parts += [text[at:start], shown[k][first : len(shown[k]) - max(0, end - e)]]
            at = end
        return kind.new("".join([*parts, text[at:e]]), STILL, False) is None

    for k in reversed(range(len(good))) if back else range(len(good)):
        kind = good[k][2]
        while True:
            shown[k] = kind.new(shown[k], net, back)
            if all(fails(*span) for span in meets[k]):
                break
    return shown


def find_private(text: str, net: Feistel, back: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all values, apart from each other; a found one hides what overlaps it."""
    has_digit = DIGIT.search(text) is not None
    taken = bytearray(len(text))
    good: list[tuple[int, int, Kind]] = []
    bad: list[tuple[int, int, Kind]] = []
    for kind in ALL_KINDS:
        hint = kind.hint
        if not (hint in text if isinstance(hint, str) else has_digit if hint is DIGIT else hint.search(text)):
            continue
        right, wrong = valid_spans(kind, text, taken)
        good += [(s, e, kind) for s, e in right]
        bad += [(s, e, kind) for s, e in wrong]
    good.sort(key=lambda span: span[:2])
    for (start, end, kind), new in zip(good, renewed(text, good, bad, net, back)):
        yield start, end, kind.name, new


def pseudonymise_text(text: str, net: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    found = sorted(find_private(text, net, back))
    counts: dict[str, int] = {}
    out, last = [], 0
    for start, end, kind, new in found:
        out += [text[last:start], new]
        last = end
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[last:]]) if found else text, counts


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its texts; ``back=True`` turns them into the values again.

    ``counts=True`` adds n_<kind> for each kind.
    """
    names = [f"n_{k.name}" for k in KINDS] if counts else []
    shaped = docs.withColumns({n: F.lit(0).cast("long") for n in names}) if names else docs
    at, places = shaped.columns.index(text), [shaped.columns.index(n) for n in names]

    def change(part):
        net = Feistel(key)
        done = [(t, {}) if t is None else pseudonymise_text(t, net, back) for t in part.column(at).to_pylist()]
        columns = part.columns
        columns[at] = pa.array([t for t, _ in done], pa.string())
        for place, kind in zip(places, KINDS):
            columns[place] = pa.array([c.get(kind.name, 0) for _, c in done], pa.int64())
        return columns

    return map_rows(shaped, change)


@query("op7_private_data")
def op7_private_data(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = pseudonymise(docs, b"the key of this query", counts=True)
    total = sum((F.col(f"n_{k.name}") for k in KINDS[1:]), F.col(f"n_{KINDS[0].name}"))
    return out.withColumn("n_found", total).withColumn("private", F.col("n_found") > 0)
