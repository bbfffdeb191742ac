"""Vectors of a table as integer matrices, batch by batch.

A row is left out if its vector is null, holds null or non-finite entries, or isn't as long as the most usual length of
the others (ties: the greater length). Integers beyond ``LARGEST`` in size are an error, since their squares wouldn't add up
exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 23


def sound(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has finite entries alone."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return rows.filter(vector.isNotNull() & finite & (F.size(vector) > 0))


def usual_length(rows: DataFrame, vector_col: str) -> int:
    """0 for no rows."""
    first = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrices(batches: Iterable, column: int, length: int, to_integers: Callable, most: int = 8192) -> Iterator:
    """Slices of batches of at most ``most`` rows, and their vectors as rows of int64."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            flat = part.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            real = to_integers(flat.reshape(part.num_rows, length))
            if not (np.abs(real) <= LARGEST).all():
                raise ValueError(f"an entry is beyond {LARGEST} in size")
            yield part, real.astype(np.int64)
