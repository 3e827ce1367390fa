"""Points in time as zone-free literals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def moment(at: datetime) -> Column:
    """TIMESTAMP_NTZ literal. It means the same in every session time zone, and filters on it
    reach Parquet."""
    return F.expr(f"TIMESTAMP_NTZ '{at:%Y-%m-%d %H:%M:%S.%f}'")


# Zone-free times subtract to an exact interval; differences taken through TIMESTAMP would
# gain or lose an hour where the session's zone changes its clock.

def whole_days_between(earlier: Column, later: Column) -> Column:
    """Completed 24 hour periods, rounded down. Not a difference of calendar dates."""
    almost_a_day = F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")
    passed = F.date_part(F.lit("DAY"), later - earlier)
    ahead = -F.date_part(F.lit("DAY"), earlier - later + almost_a_day)
    return F.when(later >= earlier, passed).otherwise(ahead).cast("int")


def seconds_between(earlier: Column, later: Column) -> Column:
    passed = later - earlier
    part = lambda unit: F.date_part(F.lit(unit), passed).cast("bigint")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
