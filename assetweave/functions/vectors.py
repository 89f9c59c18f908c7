"""Vectors as arrays of float."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Products summed as doubles in index order; the sum is a float."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x).cast("float")


def dot_batch(vector: Sequence[float]):
    """The same for one query vector, over Arrow batches: faster where vectors are long."""
    query = np.asarray(vector, dtype=np.float64)

    @F.pandas_udf("float")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            matrix = np.vstack(rows.to_numpy()).astype(np.float64) if len(rows) else np.empty((0, len(query)))
            # Summed dimension by dimension, so that the order is that of dot().
            total = np.zeros(len(matrix))
            for d in range(len(query)):
                total += matrix[:, d] * query[d]
            yield pd.Series(total.astype(np.float32))

    return scores


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda total, x: total + x))


def l2_normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(v)
    by = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(v, lambda x: (x.cast("double") / by).cast("float"))


def l2_normalize_of(v) -> np.ndarray:
    v = np.asarray(v, dtype=np.float32)
    n = float(np.sqrt(np.sum(v.astype(np.float64) ** 2))) or 1.0
    return (v.astype(np.float64) / n).astype(np.float32)


def mean_vector(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """One normalised mean vector per owner: sums by dimension are partial before they move."""
    each = df.select(*by, F.posexplode(vector).alias("d", "x"))
    sums = each.groupBy(*by, "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias(vector))
    return whole.withColumn(vector, l2_normalize(F.col(vector)))


def encode(vector: Sequence[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(vector, dtype="<f4").tobytes()


def decode(blob: bytes) -> list[float]:
    return np.frombuffer(blob, dtype="<f4").tolist()
