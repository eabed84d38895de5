"""Vector arithmetic on arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero, so that such rows rank last."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hash_vector(text: Column, size: int = 8) -> Column:
    """A deterministic stand-in embedding: the first bytes of the text's SHA-256, scaled to [-1, 1]."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: (F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") / 127.5 - 1.0).cast("float"),
    )
