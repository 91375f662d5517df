"""Vector functions as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of length 0, null for none."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size.isNotNull(), 0.0)


def hashed_unit_vector(text: Column, dim: int) -> Column:
    """unsigned 32-bit words of SHA-256(`text::counter`), centred, scaled to length 1."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  c is computed once a row, whatever f does with it
    digests = F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // 8)), lambda i: F.sha2(F.concat(text, F.lit("::"), i.cast("string")), 256))
    word = lambda d, i: F.conv(F.substr(F.get(d, F.floor(i / 8).cast("int")), F.pmod(i, F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("double")
    raw = once(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: word(d, i) / F.lit(float(2**32)) - 0.5))
    return once(raw, lambda v: once(norm(v), lambda n: F.transform(v, lambda x: x / n)))
