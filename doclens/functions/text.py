"""Column functions on text: lengths in UTF-16 units, white space, times, quotes, entities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as editors trim it: \\s and the Unicode blanks and marks.
BLANKS = r"[\s   -     　﻿]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf16_len(text: Column) -> Column:
    """Length in UTF-16 code units: supplementary characters count two."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def low_half(utf16: Column, at: Column) -> Column:
    """Whether the UTF-16LE unit at a place is the second half of a character of two units."""
    return F.coalesce(F.hex(F.substring(utf16, 2 * at + 2, F.lit(1))).between("DC", "DF"), F.lit(False))


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The text from one UTF-16 offset to another; a character of two units belongs where its first one lies."""

    def cut(utf16: Column) -> Column:
        first, last = start + low_half(utf16, start).cast("int"), end + low_half(utf16, end).cast("int")
        wide = F.decode(F.substring(utf16, 2 * first + 1, 2 * (last - first)), "UTF-16LE")
        return F.when(F.octet_length(utf16) == 2 * F.length(text), F.substring(text, start + 1, end - start)).otherwise(wide)

    return let(F.encode(text, "UTF-16LE"), cut)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; there is no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank; single blanks, as nearly all are, are not matched."""
    return F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " ")


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def minute(time: Column) -> Column:
    """An ISO time as `yyyy-MM-dd HH:mm` in UTC, cut, not rounded; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(time), "yyyy-MM-dd HH:mm"), time)


def local_minute(time: Column, zone: str) -> Column:
    """The same minute on a wall clock of `zone`; the session's zone is UTC."""
    at = F.from_utc_timestamp(F.try_to_timestamp(time), zone)
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), time)


def decode_entities(text: Column) -> Column:
    """The five named entities and &nbsp;; `&amp;` last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def shorten(text: Column, most: int = 60) -> Column:
    """One line of at most `most` characters, an ellipsis for what is cut."""
    one = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle occurs in text without overlapping itself; an empty needle never does."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def occurrences_before(text: Column, needle: Column, at: Column) -> Column:
    """How often needle starts before the 0-based position `at`."""
    return occurrences(F.left(text, at + F.length(needle) - 1), needle)


def blank_line(text: Column, field: str = "fetched") -> Column:
    """The text with the first `field: ...` line blanked; two such texts are equal but for that line."""
    return F.regexp_replace(text, rf"(?ms)\A(.*?)^{field}: [^\n]*$", f"$1{field}:")


def quoted(text: Column) -> Column:
    """Every line behind `> `, an empty one behind `>`."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def wall_stamp(iso: Column) -> Column:
    """`yyyy-MM-dd HHmm` read off the text of a wall clock, never converted; dates alone stay dates."""
    return F.when(F.length(iso) > 10, F.concat(F.substring(iso, 1, 10), F.lit(" "), F.substring(iso, 12, 2), F.substring(iso, 15, 2))).otherwise(iso)


def checksum(value: Column) -> Column:
    return F.sha2(value, 256)
