"""Columns whose results differ from Spark's defaults: errors give NULL, integers divide to integers, lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {
    "int": "int", "integer": "int", "serial": "int", "smallint": "smallint", "bigint": "bigint", "float": "double", "double": "double", "boolean": "boolean", "varchar": "string",
    "text": "string", "json": "string", "jsonb": "string", "uuid": "string", "date": "date", "timestamp": "timestamp_ntz", "decimal": "decimal(18,2)", "numeric": "decimal(18,2)",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division that truncates; NULL by zero."""
    return F.call_function("div", col(a), F.nullif(col(b), F.lit(0)))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Division as double; NULL by zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def int_mod(a: Column | str, b: Column | str) -> Column:
    """Remainder with the dividend's sign; NULL by zero."""
    return F.try_mod(col(a), col(b))


def float_mod(a: Column | str, b: Column | str) -> Column:
    """Floored modulo for a positive divisor; NULL by zero."""
    return F.pmod(col(a), F.nullif(col(b), F.lit(0.0)))


def byte_length(c: Column | str) -> Column:
    return F.octet_length(col(c))


def trim_space(c: Column | str) -> Column:
    """Without space, tab, line feed and carriage return at both ends."""
    return F.btrim(col(c), F.lit(" \t\n\r"))


def substring_from(c: Column | str, start: int | Column, length: int | Column | None = None) -> Column:
    """1-based; NULL for a start below 1, empty past the end or for a negative length."""
    s = F.lit(start) if isinstance(start, int) else start
    n = F.length(col(c)) if length is None else F.greatest(F.lit(0), F.lit(length) if isinstance(length, int) else length)
    return F.when(s >= 1, F.substring(col(c), s, n))


def whole(c: Column | str, up: bool) -> Column:
    """CEIL or FLOOR as a double."""
    return (F.ceil(col(c)) if up else F.floor(col(c))).cast("double")
