"""Plain analytic shapes: curated table, monthly rollup, group averages, joins, top groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def curated(rows: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Filter and projection behind a curated table; both reach the scan."""
    return rows.where(condition).select(*columns)


def create_table_as(rows: DataFrame, table: str) -> None:
    rows.write.mode("overwrite").saveAsTable(table)


def month_of(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")


def monthly_rollup(rows: DataFrame, day: Column, amount_text: Column) -> DataFrame:
    """Rows and summed amount per month. The amount is text; what does not parse is left out."""
    return rows.groupBy(month_of(day).alias("month")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.sum(amount_text.try_cast("double")), 2).alias("amount")
    )


def top_months(rollup: DataFrame, months: int = 12) -> DataFrame:
    return rollup.orderBy(F.col("month").desc()).limit(months)


def average_by(rows: DataFrame, group: str, amount: Column) -> DataFrame:
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(amount), 2).alias("average")
    )


def joined_amounts(facts: DataFrame, dimension: DataFrame, on: Column, group: str, amount_text: Column) -> DataFrame:
    return (
        facts.join(dimension, on)
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("total"), F.round(F.sum(amount_text.try_cast("double")), 2).alias("amount"))
    )


def top_groups(rows: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """Largest groups; ties go to the smaller key."""
    return (
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.col("total").desc(), group)
        .limit(limit)
    )
