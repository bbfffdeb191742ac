"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has its top bits zero, but not before ``least`` bytes
and at ``most`` at the latest, so an insertion moves only the ends around it. Chunks are told apart by a
128-bit digest; every occurrence but the first (by document id, then place) is a duplicate. With ``context``, a run of
adjacent duplicates then grows byte by byte, by up to so many bytes on each side, as long as the bytes around it are
those around the first occurrence of its first and last chunk, so that chunk ends don't limit what is found. Runs of
at least ``run_bytes`` are removed from the text.

Most chunks occur once: a first round sends halves of digests, packed by unit and range, to learn which ones may repeat; only
those become rows with digest and place, combine before they are shuffled and meet the first occurrence. A unit
sends a digest once, and adaptive execution splits a digest that many documents hold. A document's removed chunks
never outnumber its chunks.

Defined results: a null text stays null and has no bytes; rows alike in id and text are one document, and each
of them gets its result; null ids come first; an empty table gives no rows. Columns of ``docs`` are carried
along; names the operator adds start with ``x_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, staged, table
from tidemark.llm.exchange import UNIT_BYTES, arrays, meet, parts, ranges_of, split_by_range, unit_name

WINDOW = 16
#: What the query and the pipeline run with: chunks of about 32 bytes find passages of some 50 words, whose runs grow to their ends.
REGISTERED = {"least": 16, "bits": 4, "context": 512}


def gear_table():
    """256 random words: splitmix64 of the byte."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def cut_points(data, gear, bits: int):
    """Places where a chunk may end: behind a byte whose gear hash has ``bits`` zero top bits, moved to the next
    start of a UTF-8 character. ``h[i]``: sum of ``gear[data[i - j]] << j`` over 16 bytes, by doubling."""
    import numpy as np

    h = gear[data]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint64(k)
        h = more
    at = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    for _ in range(3):
        inside = at < len(data)
        at[inside] += (data[at[inside]] & 0xC0) == 0x80
    return at


def chunk_ends(data, starts, gear, least: int, most: int, bits: int) -> list[list[int]]:
    """The ends of each document's chunks; ``starts`` has each document's first byte and the end of all."""
    may = cut_points(data, gear, bits).tolist()
    out, k, n = [], 0, len(may)
    for at, stop in zip(starts[:-1], starts[1:], strict=True):
        ends = []
        while at < stop:
            while k < n and may[k] < at + least:
                k += 1
            to = may[k] if k < n and may[k] <= at + most else at + most
            while to < stop and data[to] & 0xC0 == 0x80:
                to += 1
            at = min(to, stop)
            ends.append(at)
        out.append(ends)
    return out


def unit_of(batch, gear, least: int, most: int, bits: int):
    """A batch's chunks in order: their digests (two longs each), sizes, and each document's number of them."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
    whole = b"".join(texts)
    starts = [0, *np.cumsum([len(t) for t in texts]).tolist()]
    ends = chunk_ends(np.frombuffer(whole, np.uint8), starts, gear, least, most, bits)
    flat = [x for e in ends for x in e]  # a document's first chunk starts where the one before it ends
    names = b"".join(xxh3_128_digest(whole[f:e]) for f, e in zip([0, *flat], flat, strict=False))
    return np.frombuffer(names, np.int64).reshape(-1, 2), np.diff(np.array([0, *flat], np.int64)), np.array([len(e) for e in ends], np.int64)


def repeated_chunks(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """``docs`` has ``id``, ``key``, ``text``. Chunks whose 64 bits occur twice or more: ``h1``, ``h2``, ``id``, ``key``, ``start``, ``size``.

    Most chunks occur once. A unit of texts sends the first half of each distinct digest to its range, and whether the unit holds
    it twice; it keeps the other halves and the sizes in a row of its own, and only the chunks that the ranges
    know from elsewhere become rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ranges = docs.schema["id"].dataType, ranges_of(docs.sparkSession)
    id_type = to_arrow_type(kind)

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        gear = gear_table()
        for b in by_bytes(batches, 2, UNIT_BYTES):
            digest, size, counts = unit_of(b, gear, least, most, bits)
            distinct, which, often = np.unique(digest[:, 0].view(np.uint64), return_inverse=True, return_counts=True)
            cut = split_by_range(distinct, ranges)[1]  # in order already
            keys = np.asarray(b.column(1)).astype(np.int64)
            own = arrays(b.column(0).to_pylist(), keys, counts, digest[:, 1], size.astype(np.uint16 if most < 60_000 else np.uint32), which.astype(np.uint32), cut)
            data = [arrays(distinct[cut[r] : cut[r + 1]], np.packbits(often[cut[r] : cut[r + 1]] > 1)) for r in range(ranges)]
            unit = pa.array([unit_name(keys, counts)] * (ranges + 1))
            yield pa.RecordBatch.from_arrays([unit, pa.array([*range(ranges), -1], pa.int32()), pa.array([*data, None], pa.binary()), pa.array([None] * ranges + [own], pa.binary())], ["unit", "range", "data", "own"])

    def answer(blobs):
        import numpy as np

        sent = [parts(x) for x in blobs]
        every = np.concatenate([h for h, _ in sent])
        _, of, units = np.unique(every, return_inverse=True, return_counts=True)
        again = (units > 1)[of] | np.concatenate([np.unpackbits(t, count=len(h)) for h, t in sent]).astype(bool)
        ends = np.cumsum([len(h) for h, _ in sent])
        return [arrays(np.packbits(again[e - len(h) : e]), h[again[e - len(h) : e]]) for (h, _), e in zip(sent, ends.tolist(), strict=True)]

    def gather(unit, own, answers):
        import numpy as np
        import pyarrow as pa

        ids, keys, counts, h2, size, which, cut = parts(own)
        said = [parts(x) for x in answers]
        again = np.concatenate([np.unpackbits(bits_, count=int(n)) for (bits_, _), n in zip(said, np.diff(cut), strict=True)]).astype(bool)
        h1 = np.zeros(len(again), np.uint64)
        h1[again] = np.concatenate([h for _, h in said])
        at = np.flatnonzero(again[which])
        of = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(size.astype(np.int64))
        base = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        start = ends[at] - size[at] - base[of[at]]
        return pa.table([pa.array(h1[which[at]].view(np.int64)), pa.array(h2[at]), pa.array([ids[i] for i in of[at].tolist()], id_type), pa.array(keys[of[at]]), pa.array(start.astype(np.int32)), pa.array(size[at].astype(np.int32))], ["h1", "h2", "id", "key", "start", "size"])

    return meet(docs.select("id", "key", "text").mapInArrow(pack, "unit long, range int, data binary, own binary"), answer, gather, f"h1 long, h2 long, id {kind.simpleString()}, key long, start int, size int")


def duplicate_chunks(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """Occurrences but the first: one row for each document that has any, ``id``, ``key``, ``cells`` (``start``, ``size``, ``first``)."""
    place = F.struct("id", "key", "start")
    found = staged(repeated_chunks(docs, least, most, bits), "chunk-repeats")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return again.groupBy("id", "key").agg(F.collect_set(F.struct("start", "size", "first")).alias("cells"))


def runs_of(cells) -> list[list]:
    """Adjacent cells as ``[start, end, first cell, last cell]``."""
    runs: list[list] = []
    for c in sorted(cells or (), key=lambda c: c["start"]):
        if runs and runs[-1][1] == c["start"]:
            runs[-1][1:] = c["start"] + c["size"], runs[-1][2], c
        else:
            runs.append([c["start"], c["start"] + c["size"], c, c])
    return runs


def joined_runs(cells: DataFrame) -> DataFrame:
    """``id``, ``key``, ``runs``: of each run of ``cells`` its ``start`` and ``stop`` and its first and last cell, ``head`` and ``tail``.
    What is inside a run isn't needed after this."""
    kind = cells.schema["id"].dataType.simpleString()
    cell = cells.schema["cells"].dataType.elementType.simpleString()

    def join(batches):
        import pyarrow as pa

        for b in batches:
            one = b.column(2).type.value_type
            run = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("head", one), ("tail", one)])
            runs = [[dict(zip(("start", "stop", "head", "tail"), r, strict=True)) for r in runs_of(x)] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(run))], ["id", "key", "runs"])

    return cells.select("id", "key", "cells").mapInArrow(join, f"id {kind}, key long, runs array<struct<start:int,stop:int,head:{cell},tail:{cell}>>")


def surroundings(docs: DataFrame, runs: DataFrame, context: int) -> DataFrame:
    """What stands around the first occurrences of the runs' ends: ``id``, ``key``, ``around`` (``at``, ``left``, ``bytes``):
    the bytes before the run that starts at ``at``, or behind the one that ends there."""
    kind = docs.schema["id"].dataType.simpleString()

    def ends(batches):
        import pyarrow as pa

        for b in batches:
            of, own, left, places, at = [], [], [], [], []
            for i, found in enumerate(b.column(2).to_pylist()):
                for run in found:
                    for edge, is_left, cell in ((run["start"], True, run["head"]), (run["stop"], False, run["tail"])):
                        there = cell["first"]["start"] + (0 if is_left else cell["size"])
                        if not is_left or edge and there:
                            of.append(i), own.append(edge), left.append(is_left), places.append(cell["first"]), at.append(there)
            take = pa.array(of, pa.int64())
            f_id = pa.array([f["id"] for f in places], b.column(0).type)
            f_key = pa.array([f["key"] for f in places], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(own, pa.int32()), pa.array(left, pa.bool_()), f_id, f_key, pa.array(at, pa.int32())], ["id", "key", "own", "left", "f_id", "f_key", "at"])

    edges = runs.select("id", "key", "runs").mapInArrow(ends, f"id {kind}, key long, own int, left boolean, f_id {kind}, f_key long, at int")
    wanted = edges.groupBy("f_id", "f_key").agg(F.collect_set(F.struct("at", "left")).alias("wanted"))
    meant = (F.col("key") == F.col("f_key")) & F.col("id").eqNullSafe(F.col("f_id"))

    def cut(batches):
        import pyarrow as pa

        for b in by_bytes(batches, 2):
            of, at, left, found = [], [], [], []
            for i, (t, places) in enumerate(zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for p in places:
                    there = t[max(0, p["at"] - context) : p["at"]] if p["left"] else t[p["at"] : p["at"] + context]
                    if there:
                        of.append(i), at.append(p["at"]), left.append(p["left"]), found.append(there)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(left, pa.bool_()), pa.array(found, pa.binary())], ["f_id", "f_key", "at", "left", "bytes"])

    texts = docs.join(wanted, meant).select("id", "key", "text", "wanted")
    # Rows alike in id and text give the same bytes.
    there = texts.mapInArrow(cut, f"f_id {kind}, f_key long, at int, left boolean, bytes binary").groupBy("f_id", "f_key", "at", "left").agg(F.min("bytes").alias("bytes"))
    there = staged(there, "chunk-contexts")  # frees the texts before the bytes go to the runs
    there = there.select(*[F.col(c).alias(f"t_{c}") for c in there.columns])
    same = (F.col("f_key") == F.col("t_f_key")) & F.col("f_id").eqNullSafe(F.col("t_f_id")) & (F.col("at") == F.col("t_at")) & (F.col("left") == F.col("t_left"))
    return edges.join(there, same).groupBy("id", "key").agg(F.collect_set(F.struct(F.col("own").alias("at"), "left", F.col("t_bytes").alias("bytes"))).alias("around"))


def grown(t: bytes, doc, runs: list[dict], around) -> list[list[int]]:
    """``runs`` of the document ``doc`` (id, key), each grown while its bytes are those of ``around``; runs that meet are one. Whole characters only;
    a run doesn't grow into the first occurrence it is told by."""
    near = {(x["at"], x["left"]): x["bytes"] for x in around or ()}
    out: list[list[int]] = []
    for run in runs:
        a, e, head = run["start"], run["stop"], run["head"]
        before, behind = near.get((a, True), b""), near.get((e, False), b"")
        first = head["first"]
        floor = first["start"] + head["size"] if (first["id"], first["key"]) == doc else 0
        n = 0
        while n < len(before) and a - n > floor and t[a - n - 1] == before[-n - 1]:
            n += 1
        while n and t[a - n] & 0xC0 == 0x80:
            n -= 1
        m = 0
        while m < len(behind) and e + m < len(t) and t[e + m] == behind[m]:
            m += 1
        while m and e + m < len(t) and t[e + m] & 0xC0 == 0x80:
            m -= 1
        if out and out[-1][1] >= a - n:
            out[-1] = [min(out[-1][0], a - n), max(out[-1][1], e + m)]
        else:
            out.append([a - n, e + m])
    return out


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 32, most: int = 512, bits: int = 5, run_bytes: int = 100, context: int = 0) -> DataFrame:
    """``docs`` with ``x_text`` (what is left), ``x_n_bytes``, ``x_n_removed`` and ``x_spans`` (removed runs as
    ``start``, ``end`` in bytes)."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    runs = joined_runs(duplicate_chunks(named, least, most, bits))
    if context:
        runs = staged(runs, "chunks")
        around = surroundings(named, runs, context).select(F.col("id").alias("x_id"), F.col("key").alias("x_key"), "around")
        runs = runs.join(around, (F.col("key") == F.col("x_key")) & F.col("id").eqNullSafe(F.col("x_id")), "left").select("id", "key", "runs", "around")
        runs = staged(runs, "chunk-surroundings")  # frees the bytes on their way, before the texts go again
    else:
        runs = runs.withColumn("around", F.lit(None).cast("array<struct<at:int,left:boolean,bytes:binary>>"))
    cells = runs.select(F.struct("id", "key", "runs", "around").alias("x_cells"))
    marked = docs.withColumn("x_key2", F.xxhash64(text_col)).join(cells, (F.col("x_key2") == F.col("x_cells.key")) & F.col(id_col).eqNullSafe(F.col("x_cells.id")), "left").drop("x_key2")
    where, text_at = marked.columns.index("x_cells"), marked.columns.index(text_col)
    names = [*docs.columns, "x_text", "x_n_bytes", "x_n_removed", "x_spans"]

    def remove(batches):
        import pyarrow as pa

        for b in by_bytes(batches, text_at):
            left, sizes, removed, spans = [], [], [], []
            for t, marks in zip(b.column(text_at).cast(pa.binary()).to_pylist(), b.column(where).to_pylist(), strict=True):
                runs = grown(t, (marks["id"], marks["key"]), marks["runs"], marks["around"]) if marks else []
                runs = [r for r in runs if r[1] - r[0] >= run_bytes]
                if runs:
                    at, out = 0, []
                    for a, e in runs:
                        out.append(t[at:a])
                        at = e
                    left.append(b"".join([*out, t[at:]]))
                else:
                    left.append(t)
                sizes.append(len(t or b""))
                removed.append(sum(e - a for a, e in runs))
                spans.append([{"start": a, "end": e} for a, e in runs])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [b.column(i) for i in range(b.num_columns) if i != where] + [pa.array(left, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.mapInArrow(remove, f"{fields}, x_text string, x_n_bytes long, x_n_removed long, x_spans array<struct<start:int,end:int>>")


def op3_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), **REGISTERED)
    return out.select("doc_id", F.col("x_n_bytes").alias("n_bytes"), F.col("x_n_removed").alias("n_removed"), F.size("x_spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("x_text", F.lit("")), 256).alias("kept_sha256"))
