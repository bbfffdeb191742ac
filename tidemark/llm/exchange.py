"""Values of many documents meet by value, and the answers go back to the documents.

A task packs the values of some tens of MB of texts by their range and sends each range's to one place: one row
for each range, and one row of the unit's own with what its documents need afterwards. Each range is
answered by one task, whose answers meet the unit's own row again. Values travel as arrays, so that a row is
some KB and not some bytes. The number of ranges is about twice the session's shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

UNIT_BYTES = 4 << 20


def ranges_of(spark: SparkSession) -> int:
    return 2 << max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def unit_name(*arrays_of_documents) -> int:
    """A name for a unit, made of its documents: the same wherever and whenever it is packed."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b"".join(a.tobytes() for a in arrays_of_documents)) - (1 << 63)


def split_by_range(values, ranges: int):
    """The order that sorts ``values`` (uint64) by range but keeps it within, and the ranges' limits there."""
    import numpy as np

    where = (values >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(ranges + 1))


def meet(packed: DataFrame, answer: Callable, gather: Callable, schema: str) -> DataFrame:
    """``packed``: rows ``unit long, range int, data binary, own binary`` with one row for each unit and range, and
    one of the unit's own, of range -1. ``answer(units, data)`` gets the blobs of one range and returns
    one answer for each; ``gather(unit, own, answers)`` gets the answers in the order of ranges and returns an Arrow table.

    ``packed`` is evaluated for each kind of row, so it must be a function of tables, not of a frame whose rows
    may come in another order.
    """

    def ask(t):
        import pyarrow as pa

        return pa.table([t["unit"], t["range"], pa.array(answer(t["data"].to_pylist()), pa.binary())], ["unit", "range", "data"])

    def back(t):
        import pyarrow as pa

        rows: dict[int, list] = {}
        for r, data, own in zip(t["range"].to_pylist(), t["data"].to_pylist(), t["own"].to_pylist(), strict=True):
            rows.setdefault(r, []).append(own if r < 0 else data)
        # Units alike in all documents have one name, and get the same answers.
        if sorted(rows) != list(range(-1, len(rows) - 1)) or len({len(x) for x in rows.values()}) > 1:
            raise RuntimeError("a unit's rows are not whole: the input changed while it was read")
        answers = [rows[r][0] for r in range(len(rows) - 1)]
        return pa.concat_tables([gather(t["unit"][0].as_py(), own, answers) for own in rows[-1]])

    answers = packed.filter("range >= 0").select("unit", "range", "data").groupBy("range").applyInArrow(ask, "unit long, range int, data binary")
    own = packed.filter("range < 0").select("unit", "range", "own")
    return answers.unionByName(own, allowMissingColumns=True).groupBy("unit").applyInArrow(back, schema)


def arrays(*a) -> bytes:
    """Arrays in one blob."""
    import pickle

    return pickle.dumps(a, protocol=5)


def parts(blob: bytes) -> tuple:
    import pickle

    return pickle.loads(blob)
