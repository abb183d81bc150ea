"""Universal hashes of strings and numbers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes of a string as an array of longs."""
    code = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(code) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(code, 2 * i - 1, 2), 16, 10).cast("long"))


def linear_hash(codes: Column, a: int, b: int, c: int) -> Column:
    """(s * a + b) mod c for s the big integer of a string's bytes, by Horner's rule mod c."""
    s = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: F.pmod(acc * 256 + x, F.lit(c).cast("long")))
    return F.pmod(s * a + b, F.lit(c).cast("long"))


def trailing_zeros(value: Column) -> Column:
    """Zeros at the end of the binary form; 1 for 0, whose form is a single zero."""
    return F.length(F.bin(value)) - F.length(F.rtrim(F.bin(value), F.lit("0")))


def number_of(text: Column) -> Column:
    """A number below 2^32 for a string, from its MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
