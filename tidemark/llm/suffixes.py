"""Exact removal of repeated byte strings by minimizer fingerprints, in place of prefix doubling over ranked positions.

Removed is each byte under a string of ``length`` bytes that also starts earlier (in a smaller document id, or
earlier in the same document). Positions with equal prefixes share a rank; ranks come from longer and
longer prefixes, and a position drops out as soon as its rank is its own:

1. *Short prefixes.* Of each window of ``length`` bytes one position is ranked, that of the least hash among the
   32-byte strings in it: equal windows choose alike, so a window can only repeat if the rank of its position
   does. The ranks of all documents meet by value, and positions of a rank of their own drop out.
2. *Whole reach.* A position stands for the run of windows that chose it. Where the run's bytes are those of an
   earlier position's run, all its windows repeat, and it is done.
3. *Whole length.* The windows of those still open are ranked by their ``length`` bytes, hashed anew and
   not made of earlier ranks; a window of a rank that an earlier window has is removed.

A rank is a hash of the prefix, which the task that holds the text takes from running sums at any offset, so
only positions and ranks are shuffled. Within a unit of texts runs alike are sent once, so a text or passage
that a third of all documents share sends one position for each unit.

Defined results: a null text is empty; documents alike in id and text are one document, and none of them
removes the other; of different texts with one id the order is that of a hash; an empty table gives no
rows. Ids must be integers; null ids come first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, table
from tidemark.llm.exchange import UNIT_BYTES, arrays, meet, parts, ranges_of, split_by_range, unit_name
from tidemark.llm.words import mix

SHORT = 32
#: Bytes that are hashed at once: about a dozen numbers of 8 bytes are held for each.
SLICE = 1 << 17


class Prefixes:
    """Hashes of any substrings of ``data`` from running sums (mod 2**64)."""

    def __init__(self, data, seed: int):
        import numpy as np

        base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & (1 << 64) - 1 | 1
        power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), b, np.uint64)]), dtype=np.uint64)
        table = mix((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1)) * np.uint64(0xD1342543DE82EF95))
        self.back = power(pow(base, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * power(base)[:-1], dtype=np.uint64)])

    def of(self, start, end):
        import numpy as np

        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes]):
    """Runs of texts of about ``SLICE`` bytes: first, last, the bytes together, and each one's start."""
    import numpy as np

    at = 0
    while at < len(texts):
        upto, n = at, 0
        while upto < len(texts) and (upto == at or n + len(texts[upto]) <= SLICE):
            n += len(texts[upto])
            upto += 1
        yield at, upto, np.frombuffer(b"".join(texts[at:upto]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:upto]])]).astype(np.int64)
        at = upto


def chosen(data, starts, hashes: Prefixes, length: int):
    """For each run of windows that choose one position: the position, its first and its last window."""
    import numpy as np

    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - SHORT + 1)
    rank = hashes.of(at, at + SHORT)
    # Position in the low bits: of equal ranks the first is the least.
    key = (rank & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)
    span, have = length - SHORT + 1, 1
    while 2 * have <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    first = (key & np.uint64((1 << 28) - 1)).astype(np.int64)
    sizes = np.diff(starts)
    count = np.maximum(sizes - length + 1, 0)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[:-1], count)
    doc = np.repeat(np.arange(len(sizes)), count)
    pick = first[window]
    new = np.ones(len(window), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(new)
    last = np.concatenate([edge[1:], [len(window)]]) - 1 if len(edge) else edge
    return pick[edge], window[edge], window[last]


def earliest(value, order):
    """Whether each entry is the first of its value, by ``order``."""
    import numpy as np

    by = np.lexsort((order, value))
    v = value[by]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    out = np.empty(len(v), bool)
    out[by] = new
    return out


def narrow(x):
    """The least of ``x``, and what each has more, in the narrowest type that holds it."""
    import numpy as np

    base = int(x.min()) if len(x) else 0
    more = x.astype(np.int64).astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    return base, more.astype(np.min_scalar_type(int(more.max()) if len(x) else 0))


def wide(packed):
    import numpy as np

    base, more = packed
    return (more.astype(np.uint64) + np.uint64(base & (1 << 64) - 1)).astype(np.int64)


def send(unit: int, names, values, docs, ids, keys, ranges: int, own: tuple):
    """A unit's rows: entries of rank ``names`` and whole value ``values``, in order, ``docs`` telling whose they are.
    Entries with the value of an earlier entry of the unit stay here."""
    import numpy as np
    import pyarrow as pa

    place = np.lexsort((keys, ids))
    turn = np.empty(len(ids), np.int64)
    turn[place] = np.arange(len(ids))
    # Documents alike in id and text take one turn.
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[place][1:] == ids[place][:-1]) & (keys[place][1:] == keys[place][:-1])
    turn[place] = np.cumsum(~same) - 1
    number = np.arange(len(docs)) - np.searchsorted(docs, docs)  # of a document's entry
    order = turn[docs] << 32 | number
    go = earliest(values, order)
    again = np.zeros(len(docs), bool)
    if not go.all():
        by = np.lexsort((order, values))
        head = np.maximum.accumulate(np.where(go[by], np.arange(len(by)), 0))
        again[by] = order[by] > order[by][head]  # not for the twins of the first, alike in id and text
        go = ~again
    at, cut = split_by_range(names[go], ranges)
    # 40 bits below the range tell ranks apart well enough: a false twin is only looked at more closely. Where the
    # rank is the whole value it isn't sent twice.
    low = np.zeros((0, 5), np.uint8) if names is values else ((names[go][at] >> np.uint64(64 - 40 - (ranges.bit_length() - 1))) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy()
    high = values[go][at]
    who, which = docs[go][at], number[go][at]
    rows = []
    for r in range(ranges):
        s = slice(cut[r], cut[r + 1])
        mine, of = np.unique(who[s], return_inverse=True)
        rows.append(arrays(low[s], high[s], narrow(ids[mine]), keys[mine].astype(np.uint32), narrow(of), narrow(which[s])))
    held = arrays(*own, np.flatnonzero(go)[at].astype(np.uint32), cut, np.packbits(again))
    columns = [[unit] * (ranges + 1), [*range(ranges), -1], [*rows, None], [None] * ranges + [held]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["unit", "range", "data", "own"])


def windows_of(runs):
    """The windows of runs (first, last), one run after the other."""
    import numpy as np

    count = runs[:, 1] - runs[:, 0] + 1
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(runs[:, 0], count)


def answer(blobs: list[bytes]) -> list[bytes]:
    """For each entry of a range: 0, its rank is its own; 1, an earlier entry has its value; 2, only its rank is shared."""
    import numpy as np

    rows = [parts(b) for b in blobs]
    sizes = [len(r[1]) for r in rows]
    short, value = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    if len(short) == len(value):
        name = np.zeros((len(short), 8), np.uint8)
        name[:, :5] = short
        name = name.view("<u8")[:, 0]
    else:
        name = value
    code = np.zeros(len(name), np.uint8)
    by = np.argsort(name)
    v = name[by]
    twin = np.zeros(len(v), bool)
    same = v[1:] == v[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    some = np.sort(by[twin])
    if len(some):
        of = [wide(r[4]) for r in rows]
        ids = np.concatenate([wide(r[2])[i] for r, i in zip(rows, of, strict=True)])[some]
        keys = np.concatenate([r[3][i] for r, i in zip(rows, of, strict=True)])[some]
        which = np.concatenate([wide(r[5]) for r in rows])[some]
        n, w = name[some], value[some]
        by = np.lexsort((which, keys, ids, w, n))
        n, w, ids, keys, which = (x[by] for x in (n, w, ids, keys, which))
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        first = (ids == ids[head]) & (keys == keys[head]) & (which == which[head])
        edge = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        size = np.diff(np.concatenate([edge, [len(n)]]))
        classes = np.repeat(np.add.reduceat(new.astype(np.int64), edge), size)
        code[some[by]] = np.where(~first, 1, np.where(classes > 1, 2, 0))
    ends = np.cumsum(sizes)
    return [code[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]


def codes(own: tuple, answers: list[bytes]):
    """The answers in the order of the unit's entries; entries that stayed have the code 1."""
    import numpy as np

    at, cut, again = own
    stayed = np.unpackbits(again)  # up to seven more, for whole bytes
    n = len(at) + int(stayed.sum())
    out = stayed[:n].copy()
    out[at] = np.frombuffer(b"".join(answers), np.uint8)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``key`` (a hash of the text), ``n_bytes``, ``n_removed``, ``n_spans``, ``spans``
    (removed runs as ``start``, ``end`` in bytes), ``kept_sha256``, and ``kept``, the bytes that are left."""
    if length < 2 * SHORT:
        raise ValueError(f"strings of at least {2 * SHORT} bytes")
    ranges = ranges_of(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    packed = "unit long, range int, data binary, own binary"

    def positions(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        for b in by_bytes(batches, 2, UNIT_BYTES):
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            ids = np.array([-(1 << 63) if x is None else x for x in b.column(0).to_pylist()], np.int64)
            null = np.array([x is None for x in b.column(0).to_pylist()])
            keys = np.asarray(b.column(1))
            names, values, of = [], [], []
            for first, _, data, starts in slices(texts):
                hashes = Prefixes(data, 0)
                at, lo, hi = chosen(data, starts, hashes, length)
                names.append(hashes.of(at, at + SHORT))
                values.append(mix(hashes.of(lo, hi + length) + (at - lo).astype(np.uint64)))
                of.append(first + np.searchsorted(starts, lo, side="right") - 1)
            whole = zstandard.ZstdCompressor(level=5).compress(b"".join(texts))
            own = (ids, null, keys, np.array([len(t) for t in texts]), whole)
            yield send(unit_name(ids, keys), *(np.concatenate(x) for x in (names, values, of)), ids, keys.astype(np.uint32), ranges, own)

    def open_unit(own):
        import zstandard

        ids, null, keys, sizes, whole, *rest = own
        data = zstandard.ZstdDecompressor().decompress(whole) if sizes.sum() else b""
        texts, at = [], 0
        for n in sizes.tolist():
            texts.append(data[at : at + n])
            at += n
        return ids, null, keys, sizes, whole, texts, rest

    def windows(unit, own, answers):
        import numpy as np
        import pyarrow as pa

        ids, null, keys, sizes, whole, texts, rest = open_unit(parts(own))
        code = codes(tuple(rest), answers)
        values, of, sure, where, seen = [], [], [], [], 0
        base = np.concatenate([[0], np.cumsum(sizes)])
        for first, _, data, starts in slices(texts):
            one = Prefixes(data, 0)
            at, lo, hi = chosen(data, starts, one, length)
            mine = code[seen : seen + len(at)]
            seen += len(at)
            done = mine == 1
            sure.append(np.stack([lo[done], hi[done] + length], axis=1) + base[first])
            runs = np.stack([lo[mine == 2], hi[mine == 2]], axis=1)
            s = windows_of(runs)
            values.append(one.of(s, s + length) ^ Prefixes(data, 1).of(s, s + length) if len(s) else np.zeros(0, np.uint64))
            of.append(first + np.searchsorted(starts, s, side="right") - 1)
            where.append(runs + base[first])
        own = (ids, null, keys, sizes, whole, narrow(np.concatenate(sure).ravel()), narrow(np.concatenate(where).ravel()))
        ranks = np.concatenate(values)
        return pa.Table.from_batches([send(unit, ranks, ranks, np.concatenate(of), ids, keys.astype(np.uint32), ranges, own)])

    def remove(unit, own, answers):
        import numpy as np
        import pyarrow as pa

        ids, null, keys, sizes, _, texts, (sure, open_runs, *rest) = open_unit(parts(own))
        sure, where = wide(sure).reshape(-1, 2), windows_of(wide(open_runs).reshape(-1, 2))
        again = codes(tuple(rest), answers) == 1
        runs = np.concatenate([sure, np.stack([where[again], where[again] + length], axis=1)])
        base = np.concatenate([[0], np.cumsum(sizes)])
        step = np.zeros(base[-1] + 1, np.int32)
        np.add.at(step, runs[:, 0], 1)
        np.add.at(step, runs[:, 1], -1)
        gone = np.cumsum(step[:-1]) > 0
        out = []
        for k, t in enumerate(texts):
            g = gone[base[k] : base[k + 1]]
            spans, left = [], t
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans = [{"start": int(a), "end": int(e)} for a, e in edge.reshape(-1, 2)]
                left = np.frombuffer(t, np.uint8)[~g].tobytes()
            out.append((None if null[k] else int(ids[k]), int(keys[k]), len(t), int(g.sum()), len(spans), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "key", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    short = meet(rows.mapInArrow(positions, packed), answer, windows, packed)
    schema = "id long, key long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"
    return meet(short, answer, remove, schema)


def op8_substring_removal(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
