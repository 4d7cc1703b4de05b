"""Vector functions as columns (F4) and a stable stand-in for an embedding model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(0.0)


def unit(a: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays."""
    a = col(a)
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def digest_embedding(text: Column | str, dims: int = 8) -> Column:
    """A vector from the text's MD5: for tests, where a model would be injected."""
    return F.array(*[(F.conv(F.substring(F.md5(col(text)), 1 + 4 * i, 4), 16, 10).cast("double") / 32767.5 - 1).cast("float") for i in range(dims)])


#: An injected model: a column of text to a column of vectors, as a built-in expression or an Arrow UDF.
Embed = Callable[[Column], Column]


def with_embedding(df: DataFrame, embed: Embed, text: str = "content") -> DataFrame:
    """Embeds what has no embedding yet, once, as a column."""
    made = embed(F.col(text))
    return df.withColumn("embedding", F.coalesce("embedding", made) if "embedding" in df.columns else made)
