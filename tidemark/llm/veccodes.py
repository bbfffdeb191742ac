"""Codes of vectors: a codebook for each part of them, distances read from tables over value dictionaries.

Vectors become integers. They are kept as blocks of rows; a block has, for each dimension, the dictionary of its distinct
integers (rising) and for each row the place in it. A round tabulates, for each dimension, the squared differences
of every distinct integer to that dimension of all entries; a part's distances to the entries are then gathers
from these tables by the rows' places, and sums of them. No difference is taken for a row. The sums of an entry's parts come
from counts of (entry, place) times the dictionary. Only sums and counts by part, entry and dimension reach the
driver, which makes the next codebooks of them; blocks are written once to the shared folder and read by every round.

A block has at most ``block`` rows, so dictionaries and tables are bounded whatever the values are.

Defined results: which rows are left out says ``vectors``; a length that the parts don't divide is an error; the
codebooks start with the least ids (null ids last, ties by vector), fewer than ``entries`` if there are fewer rows;
repeated rows count as often as they stand there; an empty table gives no rows. Columns of ``rows`` other than
id, vector and label aren't carried along.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table
from tidemark.llm.vectors import matrices, sound, usual_length


def steps(real):
    import numpy as np

    return np.floor(4096.0 * real)


def blocks_of(rows: DataFrame, length: int, block: int) -> DataFrame:
    """``rows``: ids, vectors, labels. A block: its ids and labels, ``values`` (the dictionaries end to end), ``ends``
    (their ends), and ``places`` (int32 bytes, a dimension after the other)."""
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(held):
            x = np.concatenate([m for _, m in held])
            found = [np.unique(x[:, d], return_inverse=True) for d in range(length)]
            one = lambda c: pa.array([pa.concat_arrays([b.column(c) for b, _ in held]).to_pylist()], pa.list_(held[0][0].column(c).type))
            values, ends = np.concatenate([f[0] for f in found]), np.cumsum([len(f[0]) for f in found])
            places = np.concatenate([f[1].astype(np.int32) for f in found]).tobytes()
            return pa.RecordBatch.from_arrays([one(0), one(2), pa.array([values.tolist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([places], pa.binary())], ["ids", "labels", "values", "ends", "places"])

        held, n = [], 0
        for b, x in matrices(batches, 1, length, steps, block):
            if n + len(x) > block:
                yield packed(held)
                held, n = [], 0
            held.append((b, x))
            n += len(x)
        if held:
            yield packed(held)

    return rows.select("id", "vector", "label").mapInArrow(pack, f"ids array<{ids}>, labels array<{labels}>, values array<long>, ends array<long>, places binary")


def nearest(values, ends, places, books, parts: int):
    """[rows, parts]: the nearest entries (ties: the first) and their squared distances. ``books``: [entries, dimensions]."""
    import numpy as np

    length = books.shape[1]
    wide = length // parts
    n = len(places) // length
    code, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for p in range(parts):
        far = np.zeros((n, len(books)), np.int64)
        for d in range(p * wide, (p + 1) * wide):
            own = values[ends[d - 1] if d else 0 : ends[d]]
            tabled = (own[:, None] - books[None, :, d]) ** 2
            far += tabled[places[d * n : (d + 1) * n]]
        code[:, p] = far.argmin(axis=1)
        error[:, p] = far[np.arange(n), code[:, p]]
    return code, error


def unpacked(batch, row: int):
    import numpy as np

    return (batch.column("values")[row].values.to_numpy(), batch.column("ends")[row].values.to_numpy(), np.frombuffer(batch.column("places")[row].as_py(), np.int32))


def part_sums(blocks: DataFrame, books, parts: int) -> DataFrame:
    """``entry``, ``dim``, ``n`` (parts that chose the entry), ``s`` (their sum in that dimension)."""
    entries, length = books.shape

    def add(batches):
        import numpy as np
        import pyarrow as pa

        wide = length // parts
        n, s = np.zeros((entries, length), np.int64), np.zeros((entries, length), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                values, ends, places = unpacked(b, row)
                code, _ = nearest(values, ends, places, books, parts)
                rows = len(code)
                for d in range(length):
                    own = values[ends[d - 1] if d else 0 : ends[d]]
                    often = np.bincount(code[:, d // wide] * len(own) + places[d * rows : (d + 1) * rows], minlength=entries * len(own)).reshape(entries, -1)
                    n[:, d] += often.sum(axis=1)
                    s[:, d] += often @ own
        e, d = np.divmod(np.arange(entries * length), length)
        yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(d), pa.array(n.ravel()), pa.array(s.ravel())], ["entry", "dim", "n", "s"])

    return blocks.select("values", "ends", "places").mapInArrow(add, "entry long, dim long, n long, s long").groupBy("entry", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def codebooks(rows: DataFrame, blocks: DataFrame, length: int, parts: int, entries: int, rounds: int):
    """[entries, dimensions], after the rounds."""
    import numpy as np

    first = rows.orderBy(F.col("id").isNull(), "id", "vector").limit(entries).select("vector").collect()
    books = steps(np.array([r[0] for r in first], np.float64).reshape(len(first), length)).astype(np.int64)
    for _ in range(rounds if len(first) else 0):
        new = books.copy()
        for r in part_sums(blocks, books, parts).collect():  # entries x dimensions rows
            if r["n"]:
                new[r["entry"], r["dim"]] = r["s"] // r["n"]
        books = new
    return books


def encode(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, block: int = 16384):
    """The codebooks ([entries, dimensions]) and a frame of ``id``, ``label``, ``code`` (the entries of the parts), ``error``."""
    good = sound(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), "vector")
    length = usual_length(good, "vector")
    if length % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {length}")
    good = good.filter(F.size("vector") == length)
    blocks = staged(blocks_of(good, length, block), "vector-blocks")
    books = codebooks(good, blocks, length, parts, entries, rounds)
    ids, labels = (good.schema[c].dataType.simpleString() for c in ("id", "label"))

    def code(batches):
        import pyarrow as pa

        for b in batches:
            for row in range(b.num_rows):
                chosen, error = nearest(*unpacked(b, row), books, parts)
                yield pa.RecordBatch.from_arrays([b.column("ids")[row].values, b.column("labels")[row].values, pa.array(chosen.tolist(), pa.list_(pa.int64())), pa.array(error.sum(axis=1))], ["id", "label", "code", "error"])

    return books, blocks.mapInArrow(code, f"id {ids}, label {labels}, code array<long>, error long")


def op13_dictionary_codes(spark, sf_dir: str) -> DataFrame:
    books, coded = encode(table(spark, sf_dir, "embeddings"))
    entries, length = books.shape
    listed = books.reshape(entries, 8, length // 8).transpose(1, 0, 2).ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
    coded = staged(coded, "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    text = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return out.select(F.col("id").alias("vec_id"), text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds(rounds: int) -> str:
    """CTEs of the rounds over ``v`` (row, part, place in the part, integer) and ``b0`` (part, entry, place, integer)."""
    out = []
    for k in range(rounds + 1):
        out.append(
            f"a{k} AS MATERIALIZED (SELECT i, p, e, dist FROM (SELECT i, p, e, dist, row_number() OVER (PARTITION BY i, p ORDER BY dist, e) AS r FROM "
            f"(SELECT v.i, v.p, b.e, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS dist FROM v JOIN b{k} b ON b.p = v.p AND b.j = v.j GROUP BY v.i, v.p, b.e)) WHERE r = 1)"
        )
        if k < rounds:
            out.append(
                f"m{k} AS MATERIALIZED (SELECT v.p, a.e, v.j, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{k} a ON a.i = v.i AND a.p = v.p GROUP BY v.p, a.e, v.j), "
                f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"
            )
    return ",\n".join(out)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, len(embedding) // 8 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (
  SELECT i, (g - 1) // w AS p, (g - 1) % w AS j, CAST(floor(4096 * CAST(embedding[g] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT i, w, embedding, unnest(range(1, len(embedding) + 1)) AS g FROM kept)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, x FROM v WHERE i <= 16),
{_rounds(6)},
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM b6),
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a6 GROUP BY i)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.h AS codebooks_sha256
FROM kept k JOIN coded c ON c.i = k.i CROSS JOIN digest d
"""
