"""Text cleaning, slugs and hashes as column expressions."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, also outside ASCII: as a pattern and as a list of characters.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


# Character references: as browsers read them, and only those that a semicolon closes.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
CLOSED_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
FREQUENT = ("&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&middot;", "&copy;")  # known without a look at the table
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)  # the longest first
#: What numbers stand for that are no characters of their own (HTML5, "numeric character reference end state").
RENUMBERED = {str(n): html.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))}


def _table(known: dict[str, str]) -> Column:
    """A fixed table as a map literal."""
    return F.from_json(F.lit(json.dumps(known)), "map<string,string>")


def _numbered(ref: Column) -> Column:
    """The character of a reference by number."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
    code = F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000).otherwise(number)

    def char(n: Column) -> Column:
        unused = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        exact = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")  # the byte order is said first
        known = F.try_element_at(_table(RENUMBERED), n.cast("string"))
        return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(unused, "").otherwise(F.coalesce(known, exact))

    return let(code, char)


def decode_references(col: Column, closed_only: bool = False) -> Column:
    """Character references of HTML5, each decoded once, as ``html.unescape`` does; no Python worker.

    ``closed_only`` leaves a reference without its semicolon as it is. The text is cut into references
    and what lies between, so the work is linear in it.
    """
    table = _table({f"&{n}": c for n, c in html5.items()})

    def named(ref: Column) -> Column:
        exact = F.try_element_at(table, ref)
        if closed_only:
            return F.coalesce(exact, ref)
        start = F.regexp_extract(ref, f"^&(?:{'|'.join(OPEN_NAMES)})", 0)
        longest = F.when(start != "", F.concat(F.try_element_at(table, start), F.substring(ref, F.length(start) + 1, F.length(ref)))).otherwise(ref)
        return F.coalesce(exact, longest)

    def piece(p: Column) -> Column:
        value = F.when(~p.startswith("&") | (F.length(p) == 1), p)
        for ref in FREQUENT:
            value = value.when(p == ref, html.unescape(ref))
        return value.when(p.startswith("&#"), _numbered(p)).otherwise(named(p))

    pieces = F.regexp_extract_all(col, F.lit(f"{CLOSED_REFERENCE if closed_only else REFERENCE}|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(pieces, piece), "")


def collapse_space(col: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def strip_html(col: Column, closed_only: bool = False) -> Column:
    """Tags to spaces, entities decoded (see ``decode_references``), white space collapsed."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), r"<[^>]+>", " ")
    return collapse_space(let(bare, lambda b: F.when(b.contains("&"), decode_references(b, closed_only)).otherwise(b)))


def slugify(col: Column) -> Column:
    """File-safe key that keeps letters and digits of every script."""
    dashed = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}_]+", "-")
    slug = F.trim(dashed, F.lit("-"))
    return F.when(slug == "", "unknown").otherwise(slug)


def collapse_edges(col: Column) -> Column:
    """Trim white space of any script from both ends."""
    return F.trim(col, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column named in an earlier select may be copied back into the place that uses it, and
    inside a lambda that means once per element; a lambda variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_hash(col: Column, length: int = 64) -> Column:
    digest = F.sha2(col, 256)
    return digest if length >= 64 else F.substring(digest, 1, length)


def be_to_ce_year(col: Column) -> Column:
    """Buddhist-era years 2500-2599, as whole words, to the common era (minus 543)."""
    word = r"(?<![\p{L}\p{N}_])(25[0-9]{2})(?![\p{L}\p{N}_])"
    years = F.array_distinct(F.regexp_extract_all(col, F.lit(word), F.lit(1)))
    return F.aggregate(
        years,
        col,
        lambda text, year: F.regexp_replace(
            text,
            F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), year, F.lit(r"(?![\p{L}\p{N}_])")),
            (year.cast("int") - 543).cast("string"),
        ),
    )


def extract_json(col: Column) -> Column:
    """From the first opening to the last closing brace, null where there is none."""
    found = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def words(col: Column) -> Column:
    """Lower-cased runs of letters and digits: the terms of the keyword score."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
