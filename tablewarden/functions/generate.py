"""Exploding computed arrays once.

For a plain explode the optimizer infers the filter "array not empty" and pushes it below
exchanges, down to the scan. Where the array is computed (tokens of a text) that would compute
it twice, the first time before any repartitioning. The outer form infers nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_once(rows: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """Kept columns and one row per non-null item."""
    return rows.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
