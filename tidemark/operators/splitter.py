"""Splitting of texts at separators, the coarsest first (document preparation, 2.16).

A text is cut after every occurrence of the first separator. Neighbouring pieces that fit are merged up to
``size`` characters; a chunk begins with as many whole pieces of the one before as fit in ``overlap`` (and leave room
for the next piece). A piece longer than ``size`` stands for itself and is cut in the same way at the next separator, and at
last into runs of ``size`` characters. Separators stay at the end of their piece: chunks without their overlap
are the whole text.

A text is one row's work, so this is narrow: texts go to the workers in Arrow batches and nothing is shuffled. Finding the
separators is done by ``str.find``; the merging takes one step a chunk.

Defined results: NULL and empty texts give no chunk; repeated rows are split each.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Workers need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATORS = ("\n\n", "\n", " ")


def cut_points(text: str, lo: int, hi: int, separator: str | None, size: int) -> list[int]:
    """Ends of the pieces of ``text[lo:hi]``."""
    if separator is None:
        return [*range(lo + size, hi, size), hi]
    ends, at = [], lo
    while (found := text.find(separator, at, hi)) >= 0:
        at = found + len(separator)
        ends.append(at)
    return ends if ends and ends[-1] == hi else [*ends, hi]


def merged(bounds: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of pieces that lie between ``bounds``."""
    out, first, last = [], 0, len(bounds) - 1
    while True:
        end = bisect.bisect_right(bounds, bounds[first] + size) - 1
        out.append((bounds[first], bounds[end]))
        if end == last:
            return out
        first = max(first + 1, bisect.bisect_left(bounds, max(bounds[end] - overlap, bounds[end + 1] - size)))


def spans(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[tuple[int, int]]:
    """First and one past the last character of each chunk, in the order of the text."""
    out, todo = [], [(0, len(text), 0, None)]
    while todo:  # a stack: the rightmost part of the text lies at the bottom
        lo, hi, level, run = todo.pop()
        if run is not None:
            out += merged(run, size, overlap)
            continue
        parts, run = [], [lo]
        for end in cut_points(text, lo, hi, separators[level] if level < len(separators) else None, size):
            if end - run[-1] <= size:
                run.append(end)
                continue
            parts += [(0, 0, 0, run)] if len(run) > 1 else []
            parts.append((run[-1], end, level + 1, None))
            run = [end]
        parts += [(0, 0, 0, run)] if len(run) > 1 else []
        todo += reversed(parts)
    return out


def split_recursive(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """``(id, chunk_no, chunk_start, chunk_text, chunk_chars)``; numbers and starts count from 1."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    kind = df.schema[id_col].dataType.simpleString()

    def chunks(batches):
        import pyarrow as pa

        fields = [id_col, "chunk_no", "chunk_start", "chunk_text", "chunk_chars"]
        for b in batches:
            for row in range(b.num_rows):
                text = b.column(1)[row].as_py()
                if text:
                    found = spans(text, size, overlap, separators)
                    ids = b.column(0).slice(row, 1).take(pa.array([0] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(range(1, len(found) + 1), pa.int32()), pa.array([a + 1 for a, _ in found], pa.int32()), pa.array([text[a:b_] for a, b_ in found], pa.string()), pa.array([b_ - a for a, b_ in found], pa.int32())], fields
                    )

    return df.select(id_col, text_col).mapInArrow(chunks, f"`{id_col}` {kind}, chunk_no int, chunk_start int, chunk_text string, chunk_chars int")
