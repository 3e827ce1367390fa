"""Looking up rows by key in place.

A left join on a key takes a shuffle of both sides unless one is dealt by the whole key. A window over both
sides together takes one sort, and no shuffle where both are dealt alike by a part of the key, as rows of a table's
columns are by their table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def looked_up(rows: DataFrame, found: DataFrame, key: list[str], **values: Column) -> DataFrame:
    """`rows` with further columns, each an aggregate (`values`) over the rows of `found` with the same key.

    Keys may repeat on both sides. As in a join, a key with a null finds nothing. Columns of `found`, apart from the key,
    need names that `rows` has not.
    """
    whole = F.lit(True)
    for k in key:
        whole &= F.col(k).isNotNull()
    both = rows.withColumn("_asked", F.lit(True)).unionByName(found.where(whole), allowMissingColumns=True)
    window = Window.partitionBy(*key)
    names = [n for n in found.columns if n not in key]
    return both.withColumns({n: v.over(window) for n, v in values.items()}).where("_asked").drop("_asked", *[n for n in names if n not in values])
