"""Hashes of the words of whole texts, vectorised over a batch."""

from __future__ import annotations


def mix(z):
    """splitmix64's last steps."""
    import numpy as np

    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(texts, most: int = 1 << 20):
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of an Arrow array of texts, A-Z lower-cased, and each
    text's number of words; null has none."""
    import numpy as np
    import pyarrow as pa

    rows = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    hashes, counts = [], np.zeros(len(rows), np.int64)
    byte = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    upper = np.arange(256)
    upper[65:91] += 32
    byte = byte[upper]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    byte[blank] = 0
    at = 0
    while at < len(rows):  # some texts at a time, so that temporary arrays stay in the cache
        upto, n = at, 0
        while upto < len(rows) and (upto == at or n + len(rows[upto]) < most):
            n += len(rows[upto]) + 1
            upto += 1
        data = np.frombuffer(b" ".join(rows[at:upto]) + b" ", np.uint8)
        ends_of = np.cumsum([len(r) + 1 for r in rows[at:upto]])
        gap = blank[data]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if len(first):
            last = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
            size = last - first
            place = np.arange(len(data))
            place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(data))))
            power = np.ones(int(size.max()) + 1, np.uint64)
            power[1:] = np.uint64(0x9E3779B97F4A7C15)
            power = np.cumprod(power, dtype=np.uint64)
            value = byte[data]
            value *= power.take(place, mode="clip")  # beyond a word there are blanks, which count nothing
            hashes.append(mix(np.add.reduceat(value, first) + size.astype(np.uint64)))
            counts[at:upto] = np.diff(np.concatenate([[0], np.searchsorted(first, ends_of)]))
        at = upto
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(hashes, counts, k: int):
    """Hashes of each text's runs of ``k`` words (the whole text as one if it has fewer, but not none) and their numbers."""
    import numpy as np

    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    start = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(first, made)
    width = np.repeat(np.minimum(counts, k), made)
    out = width.astype(np.uint64)
    for j in range(k):
        out = np.where(j < width, mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(start + j, max(len(hashes) - 1, 0))]) if len(hashes) else out, out)
    return out, made
