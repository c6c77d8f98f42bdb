"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array of double) and whether it can have a cosine (``fine``):
    the id and the vector aren't null, no component is null or non-finite, and
    not all are zero."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.withColumn("fine", F.coalesce(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return prepared(vectors, id_col, vector_col).filter("fine").drop("fine")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Equal vectors once: rep (least id), vector, copies. Aggregated before the
    shuffle, so a vector that a third of all rows hold costs no more than others."""
    return rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled first by the largest component, so that squares neither overflow
    nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` rows, picked by the hash of their ids, as unit vectors."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(n).select("vector").toArrow()
    return unit(matrix(rows["vector"])) if rows.num_rows else np.zeros((0, 0))

