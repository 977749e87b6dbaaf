"""Dense vectors as arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    over = lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))
    return let(norm(v), over)


def checked(df: DataFrame, column: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector of the right length as floats, and the others."""
    ok = F.coalesce(F.size(column) == dimension, F.lit(False))
    return df.where(ok).withColumn(column, F.col(column).cast("array<float>")), df.where(~ok)


def asserted(vector: Column, dimension: int) -> Column:
    """The vector as floats; the query fails where its length is another."""
    wrong = F.raise_error(F.concat(F.lit(f"dimension {dimension} expected, found "), F.size(vector).cast("string")))
    return F.when(F.size(vector) == dimension, vector.cast("array<float>")).otherwise(wrong.cast("array<float>"))
