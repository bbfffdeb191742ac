"""Token ids in files of Simple-8b words.

A 64-bit word has a selector in its upper 4 bits and a fixed number of equally wide values in the lower 60.
Selector 0 is the escape for a value of over 60 bits: the word holds its place in the file's list of
such values. Ids are coded in blocks; a block begins a new word, and the offsets of all blocks stand
together, so blocks decode at once or apart.

A file (little-endian): header, offsets of blocks (u64, blocks + 1), words (u64), escaped values (u64), ids of
documents (i64), null flags of these (u8), sizes of documents (u64).
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, small_batches, stage_dir, staged, table
from tidemark.llm.tokens import encoder, with_end

MAGIC = b"S8BWORDS"
HEADER = "<8sIIQQQQ"  # magic, version, ids in a block, blocks, words, escaped values, documents
#: Values in a word, by selector; each has 60 // values bits (none for 120). Fixed by the format.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)


def widths_of(values):
    """Bits that each value needs."""
    import numpy as np

    out = np.zeros(values.shape, np.uint8)
    for b in range(0, 64):
        more = values >> np.uint64(b) > 0
        if not more.any():
            break
        out += more
    return out


def pack(values, block: int = 1024, together: int = 1024):
    """Words, offsets of blocks and escaped values of ``values`` (uint64), ``together`` blocks at a time."""
    import numpy as np

    words, sizes, escaped = [], [np.zeros(1, np.int64)], []
    for at in range(0, len(values), block * together):
        w, made, more = pack_blocks(values[at : at + block * together], block, sum(map(len, escaped)))
        words.append(w), sizes.append(made), escaped.append(more)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(words), np.cumsum(np.concatenate(sizes)).astype(np.uint64), join(escaped)


def pack_blocks(values, block: int, known: int):
    """Words, each block's number of them, and escaped values, of which ``known`` stand before. All blocks take one step
    together: each finds the selector that covers most of what lies ahead, and makes one word of it."""
    import numpy as np

    n = len(values)
    blocks = -(-n // block)
    counts = np.array(COUNTS)
    bits = np.array([60] + [0] + [60 // c for c in COUNTS[2:]])
    wide = 120
    padded = np.zeros((blocks, block + wide), np.uint64)
    body = np.zeros(blocks * block, np.uint64)
    body[:n] = values
    padded[:, :block] = body.reshape(blocks, block)
    need = widths_of(padded)
    sizes = np.full(blocks, block)
    if blocks:
        sizes[-1] = n - (blocks - 1) * block
    head, made = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    words = np.zeros((blocks, block), np.uint64)
    escaped: list = []
    few = range(len(COUNTS) - 1, 7, -1)  # selectors of up to 8 values
    while (live := np.flatnonzero(head < sizes)).size:
        at = head[live]
        top = np.maximum.accumulate(need[live[:, None], at[:, None] + np.arange(8)], axis=1)
        chosen = np.where(top[:, 0] > 60, 0, 15)
        for s in few:
            chosen[(top[:, COUNTS[s] - 1] <= bits[s]) & (chosen > 0)] = s
        for r in np.flatnonzero(chosen == 8):  # seldom for ids: many small values ahead
            run = np.maximum.accumulate(need[live[r], at[r] : at[r] + wide])
            chosen[r] = next(s for s in range(1, 9) if run[COUNTS[s] - 1] <= bits[s])
        for s in np.unique(chosen):
            rows = np.flatnonzero(chosen == s)
            b, c = live[rows], int(counts[s])
            part = padded[b[:, None], at[rows][:, None] + np.arange(c)]
            if s == 0:
                low = np.arange(len(rows)).astype(np.uint64) + np.uint64(known + len(escaped))
                escaped.extend(part[:, 0].tolist())
            elif s == 1:
                low = np.zeros(len(rows), np.uint64)
            else:
                low = np.bitwise_or.reduce(part << (np.arange(c) * bits[s]).astype(np.uint64), axis=1)
            words[b, made[b]] = np.uint64(int(s) << 60) | low
            head[b] += c
        made[live] += 1
    return words[np.arange(block) < made[:, None]], made, np.array(escaped, np.uint64)


def unpack(words, offsets, escaped, n: int, block: int = 1024):
    """All values again: the words of each selector are decoded together."""
    import numpy as np

    counts = np.array(COUNTS)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(counts[selectors])
    starts = ends - counts[selectors]
    offsets = offsets.astype(np.int64)
    block_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    base = np.concatenate([ends, [0]])[offsets[:-1] - 1] * (offsets[:-1] > 0)
    starts = starts - base[block_of] + block_of * block
    limit = np.minimum((block_of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selectors):
        rows = np.flatnonzero(selectors == s)
        c = int(counts[s])
        if s == 0:
            out[starts[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        if s == 1:
            continue
        width = 60 // c
        values = (words[rows][:, None] >> (np.arange(c) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        at = starts[rows][:, None] + np.arange(c)
        inside = at < limit[rows][:, None]
        out[at[inside]] = values[inside]
    return out


def to_file(ids, doc_ids: list, sizes, block: int = 1024) -> bytes:
    import numpy as np

    words, offsets, escaped = pack(np.asarray(ids, np.uint64), block)
    head = struct.pack(HEADER, MAGIC, 1, block, len(offsets) - 1, len(words), len(escaped), len(doc_ids))
    known = np.array([x or 0 for x in doc_ids], np.int64)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([head, *[a.tobytes() for a in (offsets, words, escaped, known, nulls, np.asarray(sizes, np.uint64))]])


def from_file(data: bytes):
    """Ids, ids of documents (null as None) and their sizes."""
    import numpy as np

    magic, version, block, blocks, n_words, n_escaped, docs = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a file of Simple-8b words")
    at = struct.calcsize(HEADER)

    def take(kind, n):
        nonlocal at
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        return a

    offsets, words, escaped = take("<u8", blocks + 1), take("<u8", n_words), take("<u8", n_escaped)
    ids, nulls, sizes = take("<i8", docs), take("u1", docs), take("<u8", docs)
    return unpack(words, offsets, escaped, int(sizes.sum()), block), [None if z else int(x) for x, z in zip(ids, nulls, strict=True)], sizes.astype(np.int64)


def write_ids(docs: DataFrame, path: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1_000_000, end: int = 0) -> DataFrame:
    """Writes files of about ``file_ids`` ids each (more only for a document of more), documents in ascending order of id (nulls first), and
    returns the manifest: ``part``, ``file``, ``path``, ``docs``, ``ids`` and ``start``, the ids before it.

    A null text is empty; repeated ids stay separate documents. Files get their names only when whole, and a
    task that runs again writes the same ones. ``vocab`` must be readable by the executors.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")

    def files(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        encode, part, number = encoder(vocab), TaskContext.get().partitionId(), 0
        store, folder = fs.FileSystem.from_uri(path)
        ids, names, sizes = [], [], []

        def flush():
            nonlocal number
            flat, each = np.concatenate(ids), np.concatenate(sizes)
            to = f"{folder}/part-{part:06d}-{number:05d}.s8b"
            with store.open_output_stream(part_name := f"{to}.{uuid.uuid4().hex}.tmp") as f:
                f.write(to_file(flat, names, each))
            store.move(part_name, to)
            row = pa.RecordBatch.from_pylist([{"part": part, "file": number, "path": to, "docs": len(names), "ids": len(flat)}], schema=manifest)
            number += 1
            ids.clear(), names.clear(), sizes.clear()
            return row

        manifest = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        for b in by_bytes(batches, 1, 1 << 20):
            flat, each = with_end(*encode(b.column(1).to_pylist()), end)
            ids.append(flat), sizes.append(each), names.extend(b.column(0).to_pylist())
            if sum(map(len, ids)) >= file_ids:
                yield flush()
        if ids:
            yield flush()

    uri = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    path = uri
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri))
    with small_batches(spark):
        made = staged(ranged.mapInArrow(files, "part int, file int, path string, docs long, ids long"), "s8b-manifest")
    before = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = made.groupBy("part").agg(F.sum("ids").alias("n"))  # one row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("start", inside).join(offsets, "part").withColumn("start", F.col("start") + F.col("first")).drop("first").withColumn("store", F.lit(uri.split("://")[0]))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. A task decodes file after file."""

    def read(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for row in b.to_pylist():
                store, _ = fs.FileSystem.from_uri(f"{row['store']}://{row['path']}")
                with store.open_input_stream(row["path"]) as f:
                    ids, names, sizes = from_file(f.read())
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].tobytes()) for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends - sizes + row["start"]), pa.array(sizes), pa.array(crc, pa.int64())], schema=out)

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few small rows would come to one task
    return manifest.repartition(files, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), stage_dir(spark, "s8b"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(manifest)
