"""The recursive splitter, and the as-of compare, against plain Python."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.quality import carried_forward
from tidemark.operators.splitter import SEPARATORS, spans, split_recursive


def plain(text, size, overlap, separators=SEPARATORS, base=0):
    """The rule of the module, piece by piece."""
    if not text:
        return []
    if separators:
        parts = text.split(separators[0])
        pieces = [p + separators[0] for p in parts[:-1]] + [parts[-1]]
    else:
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
    out, run, at = [], [], base

    def flush():
        i = 0
        while i < len(run):
            j = i
            while j + 1 < len(run) and sum(n for _, n in run[i : j + 2]) <= size:
                j += 1
            out.append((run[i][0], run[j][0] + run[j][1]))
            if j + 1 == len(run):
                break
            k = i + 1
            while k <= j and (sum(n for _, n in run[k : j + 1]) > overlap or sum(n for _, n in run[k : j + 2]) > size):
                k += 1
            i = k
        run.clear()

    for p in pieces:
        if 0 < len(p) <= size:
            run.append((at, len(p)))
        elif p:
            flush()
            out += plain(p, size, overlap, separators[1:], at)
        at += len(p)
    flush()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n", max_size=60), st.integers(2, 12), st.integers(0, 11))
def test_spans(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = spans(text, size, overlap) if text else []
    assert got == plain(text, size, overlap)
    assert all(0 < b - a <= size for a, b in got)
    covered = 0
    for a, b in got:  # whole text, in order, overlaps no longer than asked for
        assert max(0, covered - overlap) <= a <= covered < b
        covered = b
    assert covered == len(text)


def test_split_rows(spark):
    long = " ".join("word" * random.Random(i).randint(1, 5) for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (None, "x" * 1200), (4, long)]
    got = split_recursive(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), size=500, overlap=50).collect()
    assert {r.doc_id for r in got} == {3, 4, None} and sum(r.doc_id == 3 for r in got) == 2
    assert [(r.chunk_no, r.chunk_start, r.chunk_chars) for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.chunk_no)] == [(1, 1, 500), (2, 501, 500), (3, 1001, 200)]
    mine = sorted((r.chunk_start, r.chunk_text) for r in got if r.doc_id == 4)
    assert mine == [(a + 1, long[a:b]) for a, b in spans(long, 500, 50)]
    assert split_recursive(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_carried_forward(spark):
    r = random.Random(4)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * r.randrange(40))
    states = [(r.choice(["hot", "hot", "hot", "b", None]), t(), i, r.choice([1.0, 2.0, None])) for i in range(60)] + [("b", None, 99, 7.0)]
    rows = [(i, r.choice(["hot", "hot", "b", "c", None]), t(), r.choice([1.0, 2.0, None])) for i in range(80)]
    s = spark.createDataFrame(states, "k string, at timestamp_ntz, seq long, v double")
    got = {x.id: (x.expected, x.verdict) for x in carried_forward(spark.createDataFrame(rows, "id long, k string, at timestamp_ntz, held double"), s, "k", "at", "v", "seq", "held").collect()}
    for i, k, at, held in rows:
        known = [(a, q, v) for kk, a, q, v in states if kk == k and a is not None and a <= at]
        want = max(known, key=lambda x: x[:2])[2] if known else None
        verdict = "UNKNOWN" if not known and held is not None else "MATCH" if held == want else "STALE"
        assert got[i] == (want, verdict), (i, k, at)
    assert len(got) == len(rows)
