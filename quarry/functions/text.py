"""Delimited text: quoting rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_delimited(columns: list[Column], delimiter: str = ",") -> Column:
    """Quote only where needed, double inner quotes, and end lines with LF."""
    needs = f'["\r\n{re.escape(delimiter)}]'
    parts = []
    for c in columns:
        t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r\n?", "\n")
        parts.append(F.when(t.rlike(needs), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    return F.concat_ws(delimiter, *parts)


def decode_delimited(line: Column, n: int, delimiter: str = ",") -> Column:
    """The fields as an array of strings; '' for an empty field, NULL past the end."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE", "emptyValue": ""}
    parsed = F.from_csv(line, schema, options)
    fields = F.array(*(parsed[f"c{i}"] for i in range(n)))
    return F.when(F.length(line) == 0, F.array().cast("array<string>")).otherwise(F.transform(fields, lambda x: F.coalesce(x, F.lit(""))))


def finite_double(text: Column) -> Column:
    """NULL where the text is no finite number."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def split_plain(line: Column, delimiter: str = ",") -> Column:
    """Fields by the delimiter alone, without quotes; trailing empty ones stay."""
    return F.split(line, f"[{delimiter}]", -1)


def join_plain(columns: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
