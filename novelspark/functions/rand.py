"""Randomness that depends on keys only: the same on any partitioning, and in any engine with md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(*parts) -> Column:
    """A number in (0, 1) for the parts, joined by |."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def md5_mod(key: Column, n: int) -> Column:
    """md5 of key modulo n, digit by digit."""
    digits = F.transform(F.split(F.md5(key), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda r, d: (r * 16 + d) % n)
