"""Whitening of embeddings along their leading components, found by spectrum slicing.

Vectors become integers, so that sums and the covariance are exact: tasks add x, then the products of x less the floor
of its mean (small integers, centred before they are multiplied); the driver gets one row for each dimension, and
rounds the exact fractions to doubles. The number of negative pivots of LDL' of the covariance less a shift (Bunch
and Kaufman's pivots of one or two rows) is the number of eigenvalues below that shift. Bisection by these counts
isolates each of the leading eigenvalues, or a cluster too close to part; Rayleigh quotient iteration from inside the
interval gives the eigenvector, and counts on both sides of the quotient certify that it has its number. A quotient that
leaves its interval is thrown away, the interval halved, and the iteration begun anew.

The covariance has the square of the vectors' length in entries, whatever the number of rows; it alone reaches the
driver. ``identity_error`` is measured on the whitened values themselves, in another pass.

Defined results: which rows are left out says ``vectors``; repeated rows count as often as they stand there, null ids
are ids like others; components whose eigenvalue isn't above rounding (as for one row, or rows all alike) have no scale
and are left out; an empty table gives no rows. ``deviation`` is exact in decimal(38,0). Columns of ``rows`` other
than id and vector aren't carried along.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.vectors import matrices, sound, usual_length


def steps(real):
    """1/1024 steps, moved by 100,000."""
    import numpy as np

    return np.floor(1024.0 * real) + 100_000


def negative_pivots(a) -> int:
    """The number of negative eigenvalues of a symmetric matrix, by LDL' with pivots of one or two rows."""
    import numpy as np

    a = np.array(a, dtype=np.float64)
    below, tiny = 0, np.finfo(float).eps * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    while len(a):
        beside = np.abs(a[1:, 0])
        far = int(beside.argmax()) + 1 if len(beside) else 0
        most = float(beside[far - 1]) if far else 0.0
        alpha, two = (1 + 17**0.5) / 8, False
        if abs(a[0, 0]) < alpha * most:
            row = np.abs(a[far])
            row[far] = 0
            other = float(row.max())
            if abs(a[0, 0]) * other < alpha * most * most:
                if abs(a[far, far]) >= alpha * other:
                    swapped(a, 0, far)
                else:
                    two = True
                    swapped(a, 1, far)
        if two:  # such a pair has one eigenvalue of each sign
            below += 1
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
        else:
            d = a[0, 0] if abs(a[0, 0]) > tiny else tiny
            below += d < 0
            c = a[1:, 0]
            a = a[1:, 1:] - np.outer(c, c / d)
    return int(below)


def swapped(a, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def leading(a, most: int):
    """The greatest ``most`` eigenvalues above rounding (falling) and their unit vectors as columns."""
    import numpy as np

    d = len(a)
    eye, start = np.eye(d), np.random.default_rng(0).standard_normal((d, max(most, 1)))
    spread = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    high = min(float((np.diag(a) + spread).max(initial=0)), float(np.linalg.norm(a)))
    floor = 4 * d * np.finfo(float).eps * high
    if not high > 0:
        return np.zeros(0), np.zeros((d, 0))
    above = {}

    def over(shift: float) -> int:
        """How many eigenvalues are above."""
        if shift not in above:
            above[shift] = d - negative_pivots(a - shift * eye)
        return above[shift]

    values, vectors = [], np.zeros((d, 0))
    wanted = min(most, over(floor))
    while len(values) < wanted:
        k = len(values)  # eigenvalues above `top` are k, above `low` more
        low, top = floor, high * (1 + 1e-12)
        while over(low) > k + 1 and top - low > floor:
            middle = (low + top) / 2
            low, top = (middle, top) if over(middle) > k else (low, middle)
        alike = min(over(low), wanted) - k  # one, or a cluster
        found_low, found_top = low, top
        for j in range(alike):
            while True:
                value, vector, rest = quotient(a, (found_low + found_top) / 2, start[:, k + j], vectors)
                inside = found_low - floor <= value <= found_top + floor
                width = max(4 * rest, floor)
                if inside and rest <= floor and over(value + width) <= k + j and over(value - width) > k + j:
                    break
                if found_top - found_low <= floor:
                    raise ArithmeticError("no eigenvector of its number was found")
                middle = (found_low + found_top) / 2
                found_low, found_top = (middle, found_top) if over(middle) > k + j else (found_low, middle)
            values.append(value)
            vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def quotient(a, shift: float, vector, known):
    """Rayleigh quotient iteration after three steps at ``shift``, at right angles to ``known``: value, vector, size of the residual."""
    import numpy as np

    def unit(v):
        for _ in range(2):
            v = v - known @ (known.T @ v)
        return v / np.linalg.norm(v)

    v, best, eye = unit(vector), (np.inf, 0.0, vector), np.eye(len(a))
    for turn in range(30):
        rho = float(v @ (a @ v))
        rest = float(np.linalg.norm(a @ v - rho * v))
        if turn >= 3:
            if rest >= best[0] and turn > 5:
                break
            best = min(best, (rest, rho, v), key=lambda x: x[0])
        try:
            new = np.linalg.solve(a - (shift if turn < 3 else rho) * eye, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            new = np.linalg.solve(a - (rho + np.finfo(float).eps * max(abs(rho), 1e-300)) * eye, v) if turn < 3 else v
        if not np.isfinite(new).all():
            break
        v = unit(new / np.abs(new).max())
    return best[1], best[2], best[0]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: object
    vectors: object
    trace: float
    identity_error: float | None = None


def sums_of(rows: DataFrame, length: int, take) -> tuple[int, list[list[int]]]:
    """Adds the matrices (``length`` rows of integers) that ``take`` makes of each matrix of vectors; one row a dimension
    reaches the driver."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        n, held = 0, None
        for _, x in matrices(batches, 0, length, steps):
            n += len(x)
            new = take(x)
            held = new if held is None else held + new
            if np.abs(held).max(initial=0) > 1 << 61:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array([n] * length), pa.array(held.tolist(), pa.list_(pa.int64()))], ["d", "n", "s"])
                n, held = 0, None
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array([n] * length), pa.array(held.tolist(), pa.list_(pa.int64()))], ["d", "n", "s"])

    parts = rows.mapInArrow(add, "d long, n long, s array<long>").select("d", "n", F.posexplode("s").alias("e", "v"))
    cells = parts.groupBy("d", "e").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # length x length at most
    wide = 1 + max((r["e"] for r in cells), default=-1)
    out = [[0] * wide for _ in range(length)]
    for r in cells:
        out[r["d"]][r["e"]] = int(r["v"])
    return (cells[0]["n"] if cells else 0), out


def fit(vectors: DataFrame, length: int, components: int) -> Whitening:
    """``vectors``: one column of sound vectors of this length."""
    import numpy as np

    n, sums = sums_of(vectors, length, lambda x: x.sum(axis=0)[:, None])
    total = [s[0] for s in sums] if n else []
    near = np.array([s // n for s in total], np.int64)

    def products(x):
        # Slices short enough that doubles add the products exactly.
        z = (x - near).astype(np.float64)
        largest = max(1.0, float(np.abs(z).max(initial=0)))
        rows = max(1, int(2.0**53 / largest**2))
        out = np.zeros((length, length), np.int64)
        for at in range(0, len(z), rows):
            part = z[at : at + rows]
            out += (part.T @ part).astype(np.int64)
        return out

    _, square = sums_of(vectors, length, products)
    left = [s - n * int(m) for s, m in zip(total, near, strict=True)]  # sums of z
    v = np.array([[float(Fraction(n * square[i][j] - left[i] * left[j], n * n)) for j in range(length)] for i in range(length)]).reshape(length, length)
    values, axes = leading(v, components)
    return Whitening(n, total, values, axes, float(np.trace(v)))


def whitened(x, w: Whitening):
    """[rows, components]"""
    import numpy as np

    return ((w.n * x - np.array(w.sums, np.int64)) / w.n) @ w.vectors / np.sqrt(w.values)


def identity_error(vectors: DataFrame, length: int, w: Whitening) -> float:
    wide = len(w.values)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        one, two = np.zeros(wide), np.zeros((wide, wide))
        for _, x in matrices(batches, 0, length, steps):
            y = whitened(x, w)
            one += y.sum(axis=0)
            two += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * wide + wide)), pa.array(np.concatenate([two.ravel(), one]))], ["i", "v"])

    import numpy as np

    got = vectors.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(wide * wide + wide)
    for r in got:
        flat[r["i"]] = r["v"]
    mean = flat[wide * wide :] / w.n  # zero but for rounding: x is centred before it is projected
    return float(np.abs(flat[: wide * wide].reshape(wide, wide) / w.n - np.outer(mean, mean) - np.eye(wide)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each sound row and component: ``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    good = sound(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector")
    length = usual_length(good, "vector")
    good = good.filter(F.size("vector") == length)
    w = fit(good.select("vector"), length, components)
    wide = len(w.values)
    error = identity_error(good.select("vector"), length, w) if wide else None

    def out(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.array(w.sums, np.int64)
        share = w.values / w.trace if wide else w.values
        for b, x in matrices(batches, 1, length, steps):
            if not wide:
                continue
            y = w.n * x - sums
            size = (y.astype(np.float64) ** 2).sum(axis=1)
            if size.max(initial=0) < 2.0**62:
                far = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                from decimal import Decimal

                far = pa.array([Decimal(sum(int(e) ** 2 for e in r)) for r in y], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(b.num_rows), wide))
            full = b.num_rows * wide
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(again), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(full, w.n)), far.take(again), pa.array(whitened(x, w).ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(full, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.mapInArrow(out, schema)


def op12_spectrum_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))
