"""Column functions over texts: tokens, cleaning, case-insensitive counting, snippets, ids.

Positions and lengths are in code points. White space here includes U+3000, which neither trim
nor \\s of regular expressions knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character ranges that count as Han, full-width punctuation excluded.
HAN = r"一-鿿㐀-䶿豈-﫿"
_RUN = rf"[{HAN}]+|[A-Za-z0-9]+"
#: Fixed value: characters of a snippet on either side of its hit.
SNIPPET_RADIUS = 32


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value written into the expression, and worked out, once."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def _windows(run: Column, size: int) -> Column:
    """All substrings of that size; run has at least that many characters."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substr(run, i, F.lit(size)))


def windows(run: Column, size: int) -> Column:
    return F.when(F.length(run) >= size, _windows(run, size)).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Overlapping pairs of each run of Han characters (a lone one stands for itself), and lower-cased runs of ASCII letters and digits."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUN), F.lit(0))
    of_run = lambda r: F.when(r.rlike("^[A-Za-z0-9]") | (F.length(r) == 1), F.array(F.lower(r))).otherwise(_windows(r, 2))
    return F.flatten(F.transform(runs, of_run))


def clean(text: Column) -> Column:
    """Without a byte order mark, with \\n line ends, no white space before them and at most one empty line in a row."""
    lines = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?md)[ \t　]+$", ""), "\n{3,}", "\n\n")


def count_ignoring_case(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap."""
    lowered, wanted = F.lower(text), F.lower(needle)
    return ((F.length(lowered) - F.length(F.replace(lowered, wanted, F.lit("")))) / F.length(wanted)).cast("long")


def position_ignoring_case(text: Column, needle: Column) -> Column:
    """Of the first occurrence, from 0; -1 for none."""
    return F.instr(F.lower(text), F.lower(needle)) - 1


def snippet(text: Column, needle: Column) -> Column:
    """The first hit with the text around it on one line; it always ends in an ellipsis, and begins with one where the text was cut."""
    first = position_ignoring_case(text, needle)
    start = F.greatest(F.lit(0), first - SNIPPET_RADIUS)
    stop = F.least(F.length(text), first + F.length(needle) + SNIPPET_RADIUS)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, stop - start), F.lit("…"))
    return strip(F.regexp_replace(F.regexp_replace(cut, "[\n\r]", " "), r"[ \t　]{2,}", " "))


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def book_id(path: Column) -> Column:
    """The first 8 bytes of the path's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(path, 256), 1, 16)


def fingerprint(size: Column, modified: Column) -> Column:
    """size:milliseconds of a file; "unknown" if either is missing."""
    return F.coalesce(F.concat(size.cast("string"), F.lit(":"), F.unix_millis(modified).cast("string")), F.lit("unknown"))


def normalised_name(name: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(name), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space, U+3000 and U+00A0 become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s　 ]+", " "))


def strip_tags(html: Column) -> Column:
    """The text of a page: scripts and styles go with their contents, other tags leave a space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse(F.regexp_replace(bare, r"<[^>]+>", " "))


def reading_time(seconds: Column) -> Column:
    """Whole hours and minutes."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 1, "<1 min").when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h %d min", F.floor(minutes / 60), minutes % 60))
