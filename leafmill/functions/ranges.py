"""Byte offsets and half-open ranges as column expressions.

Offsets are BIGINT byte counts of UTF-8. A range is two columns, so that file statistics and
pushdown work on both ends. Where a function takes a range it takes (start, end).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_OFFSET = (1 << 32) - 1


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def is_offset(x: Column) -> Column:
    return x.isNotNull() & (x >= 0) & (x <= MAX_OFFSET)


def checked(x: Column) -> Column:
    """x, or an error where it is no offset of 32 bits."""
    return F.when(is_offset(x), x).when(x.isNull(), x).otherwise(F.raise_error(F.concat(F.lit("OFFSET_OUT_OF_RANGE: "), x.cast("string"))).cast("bigint"))


def add(a: Column, b: Column) -> Column:
    return checked(a + b)


def subtract(a: Column, b: Column) -> Column:
    return checked(a - b)


def length(start: Column, end: Column) -> Column:
    return end - start


def is_empty(start: Column, end: Column) -> Column:
    return start == end


def is_range(start: Column, end: Column) -> Column:
    return is_offset(start) & is_offset(end) & (start <= end)


def contains(start: Column, end: Column, offset: Column) -> Column:
    return (start <= offset) & (offset < end)


def contains_or_end(start: Column, end: Column, offset: Column) -> Column:
    return (start <= offset) & (offset <= end)


def covers(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Touching ends do not intersect."""
    return (a_start < b_end) & (b_start < a_end)


def includes(q_start: Column, q_end: Column, start: Column, end: Column) -> Column:
    """Whether a query range takes an element in: an empty element by its place, others by overlap."""
    return F.when(start == end, contains(q_start, q_end, start)).otherwise(intersects(q_start, q_end, start, end))


def shifted(start: Column, end: Column, by: Column) -> tuple[Column, Column]:
    return add(start, by), add(end, by)


def mapped(start: Column, end: Column, e_start: Column, e_end: Column, new_length: Column) -> Column:
    """struct(outcome, start, end): a range through one edit. Touching counts as before or after."""
    delta = new_length - (e_end - e_start)
    none = F.lit(None).cast("bigint")
    return (
        F.when(end <= e_start, F.struct(F.lit("unchanged").alias("outcome"), start.alias("start"), end.alias("end")))
        .when(e_end <= start, F.struct(F.lit("shifted").alias("outcome"), (start + delta).alias("start"), (end + delta).alias("end")))
        .otherwise(F.struct(F.lit("invalidated").alias("outcome"), none.alias("start"), none.alias("end")))
    )
