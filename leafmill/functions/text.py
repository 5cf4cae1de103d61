"""Search, slicing and comparison of texts by bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains(text: Column, needle: Column) -> Column:
    """Bytewise; the empty needle is in every text."""
    return F.contains(text.cast("binary"), needle.cast("binary"))


def first_index(text: Column, needle: Column) -> Column:
    """Byte offset of the first occurrence of a string, null if there is none, 0 for the empty string."""
    at = F.call_function("locate", needle, text)
    return F.when(F.octet_length(needle) == 0, F.lit(0)).when(at > 0, F.octet_length(F.left(text, at - 1))).cast("bigint")


def first_range(text: Column, needle: Column) -> Column:
    """struct(start, end) in bytes, null if the needle is absent."""
    at = first_index(text, needle)
    return F.when(at.isNotNull(), F.struct(at.alias("start"), (at + F.octet_length(needle)).alias("end")))


def sliced(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) as binary, null where the range leaves the text. A slice may halve a character."""
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(text))
    return F.when(inside, F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")))


def spliced(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """The bytes of text with [start, end) replaced."""
    b = text.cast("binary")
    head, tail = F.substring(b, F.lit(1), start.cast("int")), F.substring(b, (end + 1).cast("int"), F.octet_length(b))
    return F.concat(head, replacement.cast("binary"), tail)


def equals(a: Column, b: Column) -> Column:
    """Byte for byte: composed and decomposed letters differ."""
    return a == b


def escaped(text: Column) -> Column:
    """For dumps: backslash, quote, newline, carriage return and tab in escapes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
