"""Reading the tables that the queries of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathloom.tables import read_table as read

__all__ = ["label", "read"]


def label(name: str) -> Column:
    """A label without case and outer blanks; blank and null give null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", "")), F.lit(""))
