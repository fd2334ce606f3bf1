"""Column helpers for identifiers and zone codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.catalog import UNKNOWN_ZONE


def compact_id(col: Column) -> Column:
    """Trim, upper-case, drop blanks and dashes (the screening form of an id)."""
    return F.translate(F.upper(F.trim(col)), " -", "")


def padded_id(col: Column) -> Column:
    """``compact_id`` padded or cut to fourteen characters (the join form of an id)."""
    return F.rpad(compact_id(col), 14, " ")


def sale_id(col: Column) -> Column:
    """Trim and upper-case only (the form used to match land sales)."""
    return F.upper(F.trim(col))


def zone_code(col: Column) -> Column:
    z = F.replace(F.upper(F.trim(col)), F.lit(" "), F.lit(""))
    return (
        F.when(z.startswith("AU") | z.startswith("U"), z)
        .when(z.startswith("N"), F.lit("N"))
        .when(z.startswith("A"), F.lit("A"))
        .otherwise(F.lit(UNKNOWN_ZONE))
    )


def zone_rank(zone: Column) -> Column:
    """Preference among the zones that touch one parcel, best first."""
    return (
        F.when(zone.startswith("AU"), 0)
        .when(zone.startswith("U"), 1)
        .when(zone.startswith("N"), 2)
        .when(zone.startswith("A"), 3)
        .otherwise(4)
    )
