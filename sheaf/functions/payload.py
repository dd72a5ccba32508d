"""Checks on fetched content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: first bytes of a PDF.
PDF_MAGIC = "%PDF-"


def valid_pdf(content: Column) -> Column:
    """Text or binary content that starts as a PDF; null and empty content is not valid."""
    head = F.substring(content, 1, len(PDF_MAGIC)).cast("string")
    return F.coalesce(head == PDF_MAGIC, F.lit(False))


# An attribute: its name, and its value in double quotes, single quotes or none.
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ANCHOR = r"""<[aA]\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
# The named references that are decoded.
_NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, however often it is used.

    A column that is handed on is copied into each place; the variable of a lambda is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_references(text: Column) -> Column:
    """Character references by name (five), number or hexadecimal number up to U+FFFF, decoded once."""

    def char(body: Column) -> Column:
        digits = F.when(body.rlike("^#[0-9]{1,5}$"), F.substring(body, F.lit(2), F.length(body)).cast("int"))
        digits = digits.when(body.rlike("^#[xX][0-9a-fA-F]{1,4}$"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int"))
        of_number = bound(digits, lambda n: F.when((n > 0) & (n < 0x10000), F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")))
        known = F.when(F.startswith(body, F.lit("#")), of_number)
        for name, sign in _NAMED.items():
            known = known.when(body == name, F.lit(sign))
        return known

    def decoded(part: Column) -> Column:
        rest = F.substring(part, F.instr(part, ";") + 1, F.length(part))
        whole = F.concat(F.lit("&"), part)
        known = F.concat(bound(F.substring_index(part, ";", 1), char), rest)
        return F.when(F.instr(part, ";") > 0, F.coalesce(known, whole)).otherwise(whole)

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), bound(F.split(t, "&"), joined)).otherwise(t))


def redirect_target(html: Column) -> Column:
    """``href`` of the first anchor of a page whose id is ``redirect``; null without one.

    Comments are no part of the page, a quoted attribute value is one unit whatever is in it, and
    character references in the target are decoded. Only pages and anchors that have the word are
    looked at, and each pattern runs over them once.
    """

    def value(attributes: Column, name: str) -> Column:
        raw = F.get(attributes["values"], (F.array_position(attributes["names"], name) - 1).cast("int"))
        return bound(raw, lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))

    def attributes(tag: Column) -> Column:
        names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(group)) for group in (1, 2))
        return F.struct(F.transform(names, F.lower).alias("names"), values.alias("values"))

    def target(text: Column) -> Column:
        page = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|$)", "")
        anchors = F.filter(F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(0)), lambda tag: F.contains(tag, F.lit("redirect")))
        found = F.filter(F.transform(anchors, attributes), lambda tag: value(tag, "id") == "redirect")
        return decode_references(bound(F.get(found, F.lit(0)), lambda tag: value(tag, "href")))

    return bound(html.cast("string"), lambda text: F.when(F.contains(text, F.lit("redirect")), target(text)))
