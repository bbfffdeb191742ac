"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A sequence is filled greedily with the longest piece that fits. Then its smallest piece is replaced by two
pieces not packed yet, if two fit the gap that its going leaves more tightly than it did. Only documents
longer than a sequence are cut.

Pieces are dealt at random into groups of a bounded size, each packed by one task. The group's last
sequences are its only loss, a few in thousands.

Defined results: a null or empty text is its end id alone; repeated rows are packed each for itself; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, staged, table
from tidemark.llm.tokens import encoder, with_end


def best_two_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths`` (each 1 to ``room``)."""
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        places.setdefault(n, []).append(i)
    free = sum(1 << n for n in places)  # bit n: a piece of length n is left

    def longest(upto: int) -> int:
        return (free & ((2 << upto) - 1)).bit_length() - 1 if upto > 0 else 0

    def take(n: int) -> tuple[int, int]:
        nonlocal free
        i = places[n].pop()
        if not places[n]:
            free &= ~(1 << n)
        return n, i

    def give(n: int, i: int) -> None:
        nonlocal free
        places[n].append(i)
        free |= 1 << n

    out = []
    while free:
        held, gap = [], room
        while gap and (n := longest(gap)) > 0:
            held.append(take(n))
            gap -= n
        if gap and len(held) > 1:
            least, _ = held[-1]
            wide, best, pair = gap + least, least, None
            a = longest(wide - 1)
            while a > 0 and 2 * a > best and best < wide:
                b = longest(min(a, wide - a))
                if b == a and len(places[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and best < a + b <= wide:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
            if pair:
                give(*held.pop())
                held += [take(n) for n in pair]
        out.append([i for _, i in held])
    return out


def pieces(docs: DataFrame, vocab: str, room: int, id_col: str = "doc_id", text_col: str = "text", end: int = 0, fold: bool = False) -> DataFrame:
    """One row for each piece: ``row`` (a number of the document's row), ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encode = encoder(vocab, fold=fold)
        for b in by_bytes(batches, 2, 1 << 20):
            ids, sizes = with_end(*encode(b.column(2).to_pylist()), end)
            data = memoryview(ids.astype("<u4").tobytes())
            count = -(-sizes // room)
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(room, np.repeat(sizes, count) - number * room)
            first = np.repeat(np.cumsum(sizes) - sizes, count) + number * room
            crc = [zlib.crc32(data[4 * f : 4 * (f + n)]) for f, n in zip(first.tolist(), length.tolist(), strict=True)]
            of = pa.array(np.repeat(np.arange(b.num_rows), count))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(number.astype(np.int32)), pa.array(number * room), pa.array(length), pa.array(crc, pa.int64())], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"row long, doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocab: str, room: int = 2048, group_rows: int = 32_768, **columns) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there. ``fold``: the tokenizer lower-cases and takes blanks alike."""
    cut = staged(pieces(docs, vocab, room, **columns), "pieces")
    groups = -(-cut.count() // group_rows) or 1
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def fill(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths, sequence, offset = t["length"].to_pylist(), np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for k, places in enumerate(best_two_fit(lengths, room)):
            at = 0
            for i in places:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        first = t["g"][0].as_py() << 32
        return t.drop_columns(["g", "row"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    out = [f for f in cut.schema if f.name != "row"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(fill, schema)


def op6_best_two_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), fold=True)
