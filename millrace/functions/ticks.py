"""Functions over tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
_FILE_ENDING = ".CSV.GZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_symbol(c: Column) -> Column:
    """Upper case, without surrounding blanks or the ending of a file name; blank becomes null."""
    s = _trim(F.upper(c))
    s = F.when(s.endswith(_FILE_ENDING), _trim(F.substring(s, F.lit(1), F.length(s) - len(_FILE_ENDING)))).otherwise(s)
    return F.when(s != "", s)


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\f"))


def floor_div(c: Column, n: int) -> Column:
    """Exact floor division of a long (also below zero); through doubles it would round near 2**53."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def utc_day(micros: Column) -> Column:
    """Days since 1970-01-01 UTC of a count of microseconds."""
    return floor_div(micros, MICROS_PER_DAY).cast("int")
