"""Rows carried whole through a task as one struct, so that no name of theirs can clash or need quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def column(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """The named columns as a struct `row`."""
    return F.struct(*[column(n) for n in names]).alias("row")


def schema(rows: DataFrame, name: str, before: str = "", after: str = "") -> T.StructType:
    """Columns `before`, the column `name` of `rows` with its type (it may be null), columns `after`; both as DDL."""
    fields = [list(T.StructType.fromDDL(ddl).fields) if ddl else [] for ddl in (before, after)]
    return T.StructType([*fields[0], T.StructField(name, rows.schema[name].dataType), *fields[1]])
