"""The operators against SQL, brute force or exact round trips, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.llm import chunks, decontaminate, jaccard, packing, quality, resample, shard, simple8b, suffixes, trie
from tidemark.llm.common import blank_words
from tidemark.llm.eliasfano import EliasFano, coded, decoded
from tidemark.llm.registry import ORACLES, QUERIES

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, source string, n_words int, kept string, key int"
#: Names that operators use inside, all at once.
CLASHES = ["lost", "bad", "l_id", "l_key", "row", "line", "host", "cells", "items", "h_id", "h_key", "id", "at", "gram", "width", "pos", "end", "s_end", "q_id", "c_key", "__n", "__pid", "interval", "x", "n"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", ","]) + str(r.randrange(40)) for _ in range(n))


def rows():
    """Nulls in all columns, empty, blank, very long and repeated texts, ties, and names that operators use inside."""
    base = prose(1, 120)
    out = [
        (0, None, "a", 1, "x", 7), (1, "", "a", None, None, None), (2, " \t\n ", None, 2, "y", 8), (None, base, "b", 3, "z", 9),
        (3, base, "a", 4, "x", 1), (4, base, "a", 5, "x", 1), (4, base, "a", 5, "x", 1), (5, base + " end", "a", 6, "x", 1),
        (6, "Ünïcode ÄÖ 中文 " + prose(2, 60), "b", 7, "x", 1), (7, prose(3, 30_000), "b", 8, "x", 1), (8, "x" * 5_000, "b", 9, "x", 1),
        (9, "one\n\none\n two \ntwo", "b", 1, "x", 1), (10, prose(4, 90) + "\n" + base, "b", 1, "x", 1), (None, None, None, None, None, None),
    ]
    return out + [(20 + i, f"shared line here\n{prose(100 + i, 70)}", "hot", 1, "x", 1) for i in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    odd.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    from tools.oracle_check import frame_rows, type_diffs

    got = QUERIES[name](spark, SF_SMALL)
    assert frame_rows(got.toPandas()) == frame_rows(duck.execute(ORACLES[name]).fetchdf())
    assert not type_diffs(got.schema, duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", ["quality", "decontaminate", "shard"])
def test_names_that_operators_use_inside(spark, stored, name):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    run = {"quality": quality.quality_rules, "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "shard": lambda d: shard.shard(d, 5)}[name]
    wide = stored.select("*", *[(F.col("doc_id") + i).alias(c) for i, c in enumerate(CLASHES)])
    plain, got = run(stored), run(wide)
    new = [c for c in plain.columns if c not in stored.columns]
    assert got.columns == [c for c in wide.columns if name != "shard" or c != "text"] + new
    assert sorted(map(str, got.select("doc_id", *new).collect())) == sorted(map(str, plain.select("doc_id", *new).collect()))
    assert all(r[c] == (None if r.doc_id is None else r.doc_id + i) for r in got.collect() for i, c in enumerate(CLASHES))


# quality rules


def test_quality_odd_rows(stored):
    got = quality.quality_rules(stored, max_share_pct=50, min_docs=10).collect()
    assert len(got) == len(rows()) and got[0].asDict().keys() >= set(stored.columns)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.q_n_words, r.q_word_chars, r.q_n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        hot = r.source == "hot"
        assert r.q_lost_words == 3 * hot
        assert r.q_text == (r.text.replace("shared line here\n", "") if hot else r.text)
        assert r.q_kept == (len(w) >= 50 and 2 * len(covered) <= len(w))


def test_quality_rejects_depleted(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"menu {j} " + "word " * 9 + str(j) for j in range(5)) + f"\n{prose(i, 20)}", "h") for i in range(30)], "doc_id long, text string, source string")
    assert not any(r.q_kept for r in quality.quality_rules(docs, max_repeat_pct=100).collect())


# decontamination


def test_decontaminate_odd_rows(spark, stored):
    item = " ".join(prose(3, 30_000).split()[200:215])
    bench = spark.createDataFrame([("a", item), ("b", item.upper()), ("c", "ALPHA1 beta2"), ("d", None), (None, prose(1, 11)), ("e", "")], "item_id string, text string")
    for limit in (64 << 20, 0):
        got = decontaminate.decontaminate(stored, bench, broadcast_bytes=limit).collect()
        assert len(got) == len(rows())
        items = {n: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for n, t in (("a", item), ("b", item), ("c", "alpha1 beta2"), ("", prose(1, 11)))}
        for r in got:
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
            hit, found = set(), set()
            for n, words in items.items():
                k = min(10, len(words))
                grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) in grams:
                        hit |= set(range(i, i + k))
                        found.add(n)
            assert (r.c_n_words, r.c_n_hit, r.c_items, r.c_contaminated) == (len(w), len(hit), sorted(found), bool(hit))
            left = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.c_text or "").translate({c: c + 32 for c in range(65, 91)}))
            assert left == [x for i, x in enumerate(w) if i not in hit]


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([7, 64, 1024]))
def test_words_of_simple8b(values, block):
    a = np.array(values, np.uint64)
    words, offsets, escaped = simple8b.pack(a, block)
    assert simple8b.unpack(words, offsets, escaped, len(a), block).tolist() == values
    if len(a) > block:  # a block alone
        b = slice(int(offsets[1]), int(offsets[2]))
        part = a[block : 2 * block]
        assert simple8b.unpack(words[b], offsets[1:3] - offsets[1], escaped, len(part), block).tolist() == part.tolist()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        return public_tokenizers.path(name), lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")

    return load


ODD_TEXTS = [None, "", "a  b", " x", "x ", "a\n\n b", "a\xa0 \n", "a\xa0  b", "\n\n", "don't  'll", "!\x1c! a", "x\t\ty\r\nz", "<|endoftext|> a", "Ünï中文 é é"]


def test_token_files(spark, stored, tokenizer, tmp_path):
    vocab, ids_of = tokenizer("byte_bpe_50k.json")
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    docs = stored.select("doc_id", "text").union(extra)
    manifest = simple8b.write_ids(docs, f"file://{tmp_path}/ids", vocab, file_ids=2_000)
    got = sorted(simple8b.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x))
    assert manifest.count() > 3
    at, left = 0, {}
    for d, t in docs.collect():
        left.setdefault(d, []).append((len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())))
    for r in got:
        assert r.start == at
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_two_fit(lengths):
    bins = packing.best_two_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 1.3 * -(-sum(lengths) // 50) + 2


def test_two_smaller_pieces_replace_one():
    # Greedy takes 6 and 3 and leaves a gap of 1; two 2s fill it.
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in packing.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_packing(spark, stored, tokenizer):
    vocab, ids_of = tokenizer("word_bpe_49k.json")
    from tidemark.llm.tokens import Encoder

    more = [*ODD_TEXTS, "A\u0301 J\u030c T\u0308 I\u0307x", "\u212a\u0130 STRASSE \u00df\u1e9e", "A.B,C Dd. 5.5"]
    ids, sizes = Encoder(vocab, fold=True)(more)
    assert [[*x, 0] for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t).tolist() for t in more]
    got = packing.pack(stored, vocab, room=256, group_rows=50, fold=True).collect()
    want = Counter()
    for r in stored.collect():
        ids = ids_of(r.text)
        want.update((r.doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.05 * sum(r.length for r in got) / 256 + 20


# sharding


@pytest.mark.parametrize("shards, cells", [(1, 64), (5, 64), (7, 512), (100, 512)])
def test_shards(stored, shards, cells):
    got = shard.shard(stored, shards, cells=cells).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    by, texts = {}, {}
    for r in got:
        by.setdefault(r.s_shard, []).append(r)
    for x in by.values():
        assert sorted(r.s_slot for r in x) == list(range(len(x)))
    groups = Counter()
    for _, t, *_ in rows():
        groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 16
        texts.setdefault(zlib.crc32((t or "").encode()), 0)
    order = [n for _, n in sorted(groups.items())]

    def feasible(capacity):
        used, at = 1, 0
        for n in order:
            used, at = (used + 1, n) if at + n > capacity else (used, at + n)
        return used <= shards

    best = next(c for c in range(max(order), sum(order) + 1) if feasible(c))
    assert max(sum(r.s_size for r in x) for x in by.values()) <= best
    where = {}
    for r in got:
        where.setdefault(r.s_crc32, set()).add(r.s_shard)
    assert all(len(x) == 1 for x in where.values()) and set(where) == set(texts)
    if shards <= 7:
        assert set(by) <= set(range(shards))


def test_many_groups_at_registered_parameters(spark, tmp_path):
    # More groups than cells, so that hundreds of intervals are refined at once.
    n = 60_000
    text = F.concat(F.col("doc_id").cast("string"), F.expr("repeat('x', CAST(doc_id * doc_id % 397 AS INT))"), F.expr("IF(doc_id % 5000 = 7, repeat('y', 200000), '')"))
    spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op5_sharding"](spark, str(tmp_path)).toPandas()
    assert len(got) == n
    texts = [f"{i}" + "x" * (i * i % 397) + ("y" * 200_000 if i % 5000 == 7 else "") for i in range(n)]
    order = [x for _, x in sorted((hashlib.sha256(t.encode()).digest(), len(t) + 16) for t in texts)]
    ends = np.cumsum(order)

    def feasible(capacity):
        at = 0
        for _ in range(40):
            k = np.searchsorted(ends, at + capacity, side="right")
            at = ends[k - 1] if k else at
        return at >= ends[-1]

    lo, hi = max(max(order), -(-ends[-1] // 40)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(mid) else (mid + 1, hi)
    per = got.groupby("shard")
    assert per["size"].sum().max() <= lo and set(got["shard"]) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for _, s in per["slot"])


# chunks


def gear_chunks(data: bytes, gear, least, most, bits):
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        for i in range(at + least - 1, end):
            h = 0
            for j in range(chunks.WINDOW):
                h = (h + (int(gear[data[i - j]]) << j)) % 2**64
            stop = i + 1
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            if h >> (64 - bits) == 0:
                end = stop
                break
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append((at, end))
        at = end
    return out


def test_chunks(spark, stored):
    docs = stored.filter("doc_id is null or doc_id <> 7")
    got = chunks.dedup_chunks(docs, run_bytes=40).collect()
    gear, first, want = chunks.gear_table(), {}, {}
    all_rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()}, key=lambda r: (r[0], r[1]))
    for known, d, t in all_rows:
        data = t.encode()
        dup = []
        for a, e in gear_chunks(data, gear, 32, 512, 5):
            if first.setdefault(data[a:e], (known, d, a)) != (known, d, a):
                if dup and dup[-1][1] == a:
                    dup[-1][1] = e
                else:
                    dup.append([a, e])
        want[known, d, t] = [tuple(x) for x in dup if x[1] - x[0] >= 40]
    assert len(got) == docs.count()
    for r in got:
        spans = [(s.start, s.end) for s in r.x_spans]
        if r.doc_id is not None or r.text:  # of the null ids' rows the order is that of the text's hash
            assert spans == want[r.doc_id is not None, r.doc_id or 0, r.text or ""], r.doc_id
        data = (r.text or "").encode()
        left = bytes(c for i, c in enumerate(data) if not any(a <= i < e for a, e in spans))
        assert (r.x_text or "").encode() == left and r.x_n_removed == len(data) - len(left)


def test_staged_rows_leave_no_shuffle_files(spark):
    import glob
    import os
    import tempfile
    import time

    from tidemark.llm.common import staged

    roots = (os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())).split(",")
    files = lambda: {f for r in roots for f in glob.glob(f"{r}/**/blockmgr-*/*/shuffle_*", recursive=True)}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name), files()
    out = staged(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(name) == was and {r["k"]: r["count"] for r in out.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}


def test_chunks_resist_shifts(spark):
    passage = prose(77, 200)
    docs = spark.createDataFrame([(i, f"{prose(i, 30 + i)} {passage} {prose(50 + i, 20)}") for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.dedup_chunks(docs).collect()}
    assert got[0].x_n_removed == 0
    assert all(got[i].x_n_removed > 0.7 * len(passage) and got[i].x_n_removed <= len(passage) + 80 for i in range(1, 12))


def test_short_passages_go_whole(spark, tmp_path):
    """Each passage of 51 words stands in two documents, in other surroundings: all of it goes from the second, and no more than a chance byte or two."""
    n, docs, where = 150, [], {}
    for i in range(n):
        passage = prose(10_000 + i, 51)
        docs.append((i, f"{prose(20_000 + i, 20 + i % 37)} {passage} {prose(30_000 + i, 25)}"))
        before = f"Ünï {prose(40_000 + i, 30 + i % 41)} ".encode()
        docs.append((n + i, before.decode() + f"{passage} é{prose(50_000 + i, 35)}"))
        where[n + i] = len(before), len(before) + len(passage)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in chunks.dedup_chunks(spark.read.parquet(f"{tmp_path}/documents.parquet"), **chunks.REGISTERED).collect()}
    assert all(got[i].x_n_removed == 0 for i in range(n))
    for i, (a, e) in where.items():
        assert [(s.start <= a, s.end >= e) for s in got[i].x_spans] == [(True, True)], i
        assert got[i].x_n_removed <= e - a + 12
    assert {r.doc_id: r.n_removed for r in QUERIES["op3_chunk_dedup"](spark, str(tmp_path)).collect()} == {d: r.x_n_removed for d, r in got.items()}


def test_adjacent_chunks_travel_as_one_run(spark, tmp_path):
    passage = prose(900, 400)
    items = [(1, prose(901, 50) + passage), (2, passage + prose(902, 50)), (None, "x" + passage), (None, None)]
    spark.createDataFrame(items, "id long, text string").select("id", F.xxhash64("text").alias("key"), "text").write.parquet(f"{tmp_path}/d")
    cells = chunks.duplicate_chunks(spark.read.parquet(f"{tmp_path}/d"), 16, 512, 4)
    runs = {r.id: r.runs for r in chunks.joined_runs(cells).collect()}
    for r in cells.collect():
        want = chunks.runs_of([c.asDict(recursive=True) for c in r.cells])
        assert len(r.cells) > 20 > 3 >= len(want)
        assert [[x.start, x.stop, x["head"].asDict(recursive=True), x["tail"].asDict(recursive=True)] for x in runs[r.id]] == want


def test_texts_are_left_behind_when_bytes_meet_runs(spark, tmp_path):
    passage = prose(910, 60)
    items = [(1, prose(911, 50) + passage + prose(912, 9)), (2, prose(913, 50) + passage + prose(914, 9)), (None, None)]
    spark.createDataFrame(items, "id long, text string").select("id", F.xxhash64("text").alias("key"), "text").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    around = chunks.surroundings(docs, chunks.joined_runs(chunks.duplicate_chunks(docs, 16, 512, 4)), 512)
    own = {f.rpartition("/")[2] for f in docs.inputFiles()}
    assert own and not own & {f.rpartition("/")[2] for f in around.inputFiles()}  # neither texts nor their shuffles wait for the runs
    assert [(r.id, {a.left for a in r.around}) for r in around.collect()] == [(2, {True, False})]


# exact substrings


def brute_substrings(items, length=100):
    seen, out = {}, {}
    for key, data in items:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen.setdefault(data[i : i + length], (key, i)) != (key, i):
                gone[i : i + length] = b"\1" * length
        out[key] = bytes(c for c, g in zip(data, gone, strict=True) if not g), len(re.findall(b"\1+", gone))
    return out


def test_substrings(spark, stored):
    texts = [prose(5, 40), prose(5, 40)[:99], prose(5, 40)[7:], "a" * 350, "ab" * 200, prose(6, 30) + prose(5, 40)[50:190], "é" * 120 + prose(5, 30)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = stored.select("doc_id", "text").filter("doc_id is not null").union(more)
    want = brute_substrings(sorted({((r.doc_id,), (r.text or "").encode()) for r in docs.collect()}))
    got = suffixes.dedup_substrings(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        left, spans = want[(r.id,)]
        assert (bytes(r.kept), r.n_spans, r.n_removed) == (left, spans, r.n_bytes - len(left)), r.id
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and len(r.spans) == spans


def test_entries_that_stay_are_bits():
    # A unit of which all entries but one stay keeps less than a byte for each, and gets their codes back.
    n = 10_000
    values, ids = np.full(n, 7, np.uint64), np.array([3])
    t = suffixes.send(1, values, values, np.zeros(n, np.int64), ids, np.array([5], np.uint32), 32, ())
    own = t["own"].to_pylist()[-1]
    assert len(own) < n // 2
    answers = suffixes.answer([x for x in t["data"].to_pylist() if x is not None][:1])
    assert suffixes.codes(suffixes.parts(own), answers).tolist() == [0] + [1] * (n - 1)
    assert suffixes.windows_of(np.array([[3, 5], [9, 9]])).tolist() == [3, 4, 5, 9]
    assert suffixes.windows_of(np.zeros((0, 2), np.int64)).tolist() == []


def test_substrings_of_units(spark, stored, monkeypatch):
    monkeypatch.setattr(suffixes, "UNIT_BYTES", 4_000)
    monkeypatch.setattr(suffixes, "SLICE", 1_500)
    docs = stored.filter("doc_id is not null and doc_id <> 7").repartition(5, "doc_id")
    path = str(spark.conf.get("spark.sql.warehouse.dir")) + "/units"
    docs.write.mode("overwrite").parquet(path)
    want = brute_substrings(sorted({((r.doc_id,), (r.text or "").encode()) for r in docs.collect()}))
    for r in suffixes.dedup_substrings(spark.read.parquet(path)).collect():
        assert bytes(r.kept) == want[(r.id,)][0]


def test_hashing_a_unit_holds_little():
    import tracemalloc

    texts = [random.Random(k).randbytes(3_000) for k in range(700)]
    tracemalloc.start()
    found = 0
    for _, _, data, starts in suffixes.slices(texts):
        at, lo, hi = suffixes.chosen(data, starts, suffixes.Prefixes(data, 0), 100)
        found += int((hi - lo + 1).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 700 * 2_901 and peak < 20 << 20


# Jaccard


def brute_components(items, percent=75):
    sets = {}
    for d, t in items:
        w = low_words(t)
        sets.setdefault((d, t), frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[root(k)] = min(least.get(root(k), k[0]), k[0])
    return {k: (len(sets[k]), least.get(root(k)) if sets[k] else k[0]) for k in keys}


def near_copies(seed, n, words, edits):
    r = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("how", [{}, {"rounds": 0}, {"rounds": 5, "delete_upto": 0}])
def test_components(spark, tmp_path, how):
    texts = [*near_copies(1, 40, 120, 4), *near_copies(2, 25, 30, 1), *near_copies(3, 20, 14, 1), *near_copies(4, 15, 600, 18), *(prose(500 + i, 5 + i % 9) for i in range(60))]
    texts += [" ".join(WORDS[: n + 1]) for n in range(9)] + [None, "", " \n", "Same text", "same  TEXT"]
    items = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in rows() if r[0] != 7 and (r[0] is None or r[0] > 10)]
    items += [items[5], items[60]]
    spark.createDataFrame(items, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    want = brute_components(items)
    got = jaccard.jaccard_join(spark.read.parquet(f"{tmp_path}/d"), **how).collect()
    assert sorted(str((r.id, r.n_shingles, r.component_id)) for r in got) == sorted(str((d, *want[d, t])) for d, t in items)


@pytest.mark.parametrize("name, fold", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_are_kept_from_task_to_task(name, fold):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import Encoder, encoder

    path = public_tokenizers.path(name)
    assert encoder(path, fold) is encoder(path, fold)
    whole, r = Tokenizer.from_file(path), random.Random(4)
    small, large = Encoder(path, most=300, fold=fold), Encoder(path, fold=fold)
    learn, learned = large.learn, []
    large.learn = lambda names, new: (learned.append(len(new)), learn(names, new))
    batches = [[prose(50 * k + i, 60) + f" rare{r.randrange(10**9)}, x{k}." for i in range(8)] + [None, ""] for k in range(12)]
    for b in [*batches, *batches[:3]]:
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in b]
        for e in (small, large):  # the small table forgets pieces again and again
            ids, sizes = e(b)
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(learned) == 12 and learned[-1] < learned[0] / 3  # batches met before have nothing to learn
    assert len(small.ends) - 1 <= 300 + 8 * 70 and sum(len(names) for names, _ in small.levels) == len(small.ends) - 1


def test_tokenizer_starts_no_threads(tmp_path):
    """A worker has one core; the tokenizer's threads would each hold memory of their own."""
    import os
    import subprocess
    import sys

    import public_tokenizers

    code = """
import re, sys
import numpy
from tidemark.llm.tokens import encoder
threads = lambda: int(re.search(r"Threads:\\s+(\\d+)", open("/proc/self/status").read())[1])
before = threads()
encoder(sys.argv[1])([" ".join(f"{i:x}.{k}" for k in range(300)) for i in range(40)])
print(before, threads())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    out = subprocess.run([sys.executable, "-c", code, public_tokenizers.path("byte_bpe_50k.json")], env=env | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, timeout=120, check=True)
    before, after = out.stdout.split()
    assert before == after


def test_token_files_bound_the_batches_bytes(spark, tokenizer, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, seen = spark.conf.get(name, None), []
    stage = simple8b.staged

    def noted(df, to):
        long = spark.range(0, 9_000, 1, 1).select(F.repeat(F.lit("x"), 4_000).alias("t"))
        rows = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        seen.extend(r.n for r in rows.collect())
        return stage(df, to)

    monkeypatch.setattr(simple8b, "staged", noted)
    docs = spark.createDataFrame([(2, "b c"), (1, None), (None, "a")], "doc_id long, text string")
    got = simple8b.read_ids(simple8b.write_ids(docs, str(tmp_path / "f"), tokenizer("byte_bpe_50k.json")[0])).collect()
    assert sum(seen) == 9_000 and max(seen) * 4_000 <= 5 << 20
    assert spark.conf.get(name, None) == was
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2]


def sets_frame(spark, sets, path):
    """``sets``: label and tokens of each node."""
    data = [(i, 1000 - i % 7, len(t), np.sort(np.array([*t], np.uint64)).tobytes(), label) for i, (label, t) in enumerate(sets)]
    spark.createDataFrame(data, "node long, score int, n int, tokens binary, label long").write.parquet(path)
    df = spark.read.parquet(path)
    return df.drop("label"), df.select("node", "label")


def test_rare_groups_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # groups of many blocks, some of them without a member
    r, sets = random.Random(8), []
    for base in range(6):
        own = [*range(base * 100, base * 100 + 90)] + [*range(9_000, 9_010)]  # a passage that all share
        for _ in range(25):
            t = {x for x in own if r.random() > 0.13} | {r.randrange(1 << 40) for _ in range(r.randrange(4))} | {r.randrange(600) for _ in range(r.randrange(3))}
            sets.append((r.choice([-base - 1, len(sets) + 1]), t))
    sets += [(len(sets) + i, {77_000 + i % 3}) for i in range(6)] + [(len(sets) + 50, set(range(500)))]
    want = {(i, j) for i, (la, a) in enumerate(sets) for j, (lb, b) in enumerate(sets[:i]) if la != lb and 100 * len(a & b) >= 75 * len(a | b)}
    frame, left = sets_frame(spark, sets, f"{tmp_path}/s")
    pairs = jaccard.close_pairs(jaccard.rare_groups(left, frame, 75), frame, 75).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    assert len(want) > 100 and {(x.b, x.a) for x in jaccard.verify(pairs, frame, 75).collect()} == want


def test_rows_of_blocks_grow_with_the_group(spark, tmp_path):
    """Blocks of a large component don't meet each other, and lists with the same members meet once."""
    made = []
    for size in (600, 2_400):
        common = range(10_000, 10_080)  # each of these is a list of all members
        sets = [(-1, {*common, 1 + i % 9, 30 + i % 11}) for i in range(size)] + [(i, {*common, *range(100 * i, 100 * i + 25)}) for i in range(1, 21)] + [(i + 30, {*common, *range(100 * i, 100 * i + 25)}) for i in range(1, 21)]
        frame, left = sets_frame(spark, sets, f"{tmp_path}/{size}")
        made.append(jaccard.in_blocks(jaccard.rare_groups(left, frame, 75)).count())
        assert 0 < made[-1] < 3 * len(sets)
    assert made[1] < 5 * made[0]


def test_segments_find_all_partners():
    """Whatever two sets differ by within the bound, a probe of the one meets the index of the other, or a set says
    that its segments don't suffice."""
    bands, r = jaccard.Bands(75), np.random.default_rng(5)
    for trial in range(1_500):
        n = int(r.integers(1, 90))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(r.integers(0, 1 + len(a) // 5)), int(r.integers(0, 1 + len(a) // 6))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, add).astype(np.uint64)]))
        if not len(b) or not jaccard.similar(a, b, 75):
            continue
        band = bands.of(max(len(a), len(b)))
        small, large = sorted((a, b), key=len)
        assert len(large) - len(small) <= bands.differ(len(large), len(small))
        for upto in (0, 64):
            la, pa, ea = jaccard.signatures(a, bands, band, upto)
            lb, pb, eb = jaccard.signatures(b, bands, band, upto)
            for one, spare, enough, other in ((la, pa, ea, lb), (lb, pb, eb, la)):
                # Whichever lists are spared, one of the probed ones is the other's too.
                mine = one[spare >= 0]
                assert not enough or np.isin(mine, other).sum() > max(spare.max(), 0), trial


# n-gram trie


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 5_000), max_size=300), st.lists(st.integers(0, 5_000), max_size=50), st.sampled_from([5_001, 1 << 20, 1 << 62]))
def test_elias_fano(values, asked, universe):
    v = np.array(sorted(values), np.uint64)
    e = EliasFano(coded(v, universe, "a"), "a")
    assert not len(v) or e.access(np.arange(len(v))).tolist() == v.tolist()
    place, here = e.successor(np.array(asked, np.uint64))
    assert place.tolist() == np.searchsorted(v, np.array(asked, np.uint64)).tolist() and here.tolist() == [x in values for x in asked]
    c = coded(v, universe, "a")
    assert decoded(c["a_low"], c["a_high"], len(v), e.bits).tolist() == v.tolist()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, (1 << 64) - 1) | st.integers(0, 200), st.integers(1, 3) | st.integers(250, 1 << 40), min_size=1, max_size=200))
def test_trie_counts_as_sent(found):
    keys = np.array(sorted(found), np.uint64)
    count = np.array([found[int(k)] for k in keys], np.int64)
    back, n = trie.received(trie.sent(keys, count))
    assert back.tolist() == keys.tolist() and n.tolist() == count.tolist()
    assert trie.counts_at(trie.narrow(count), np.arange(len(keys))).tolist() == count.tolist()


def brute_model(texts, order=3, least=2):
    grams = [Counter(), Counter(), Counter()]
    for t in texts:
        w = [*low_words(t), None]
        for k in range(3):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n, v = sum(grams[0].values()), len(grams[0])
    pairs = {g: c for g, c in grams[1].items() if c >= least}
    counted = Counter()
    for g, c in grams[2].items():
        if g[:2] in pairs and g[1:] in pairs:
            counted[g] = c
    discount = [0, *(min(0.95, max(0.1, (one := sum(c == 1 for c in x.values())) / max(1, one + 2 * sum(c == 2 for c in x.values())))) for x in (grams[1], counted))]
    triples = {g: c for g, c in counted.items() if c >= least}
    weights = [{}, {}, {}]
    for k, level in ((1, pairs), (2, triples)):
        for g, c in level.items():
            weights[k][g[:-1]] = weights[k].get(g[:-1], 1.0) - (c - discount[k]) / grams[k - 1][g[:-1]]

    def p(context, w):
        if not context:
            return (grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        k = len(context)
        if k == 2 and context not in pairs:
            return p(context[1:], w)
        level = (None, pairs, triples)[k]
        weight = weights[k].get(context, 1.0)
        own = (level[context + (w,)] - discount[k]) / grams[k - 1][context] if context + (w,) in level else 0.0
        return own + weight * p(context[1:], w)

    def score(t):
        w = [*low_words(t), None]
        return sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)), sum(math.log10(p((), x)) for x in w), sum(grams[0][(x,)] > 0 for x in w)

    return p, score, n, grams


def test_trie(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS[: 3 + i % 9]) for _ in range(r.randrange(1, 60))) for i in range(80)] + [prose(i, 40) for i in range(5)] + [None, "", "a a a a a a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    p, score, n, grams = brute_model([t for i, t in enumerate(texts) if i % 4])
    model = trie.build_model(docs.filter("doc_id % 4 <> 0").select("text"))
    assert model.words.total == n and model.words.distinct == len(grams[0]) and model.triples.before[-1] > 10
    for row in trie.score(docs, model).collect():
        whole, base, known = score(texts[row.id])
        assert row.n_tokens == len(low_words(texts[row.id])) + 1 and row.n_known == known
        assert row.base_score == pytest.approx(base, abs=1e-6)
        assert row.score == pytest.approx(whole, abs=0.003 * row.n_tokens + 1e-6)
    for context in ((), (b"alpha",), (b"alpha", b"beta"), (b"never", b"seen")):
        assert sum(p(context, w) for (w,) in grams[0]) + p(context, "unknown") == pytest.approx(1)


def test_trie_looks_up_distinct_ngrams_once(spark, monkeypatch):
    texts = [f"{prose(k % 6, 40)} {prose(80 + k % 4, 25)}" for k in range(48)]
    model = trie.build_model(spark.createDataFrame([(t,) for t in texts[:30]], "text string").repartition(3), least=1)
    asked = []
    for name in ("weight", "of"):
        was = getattr(trie.Level, name)
        monkeypatch.setattr(trie.Level, name, lambda self, places, *a, was=was: (asked.append(places), was(self, places, *a))[1])
    tokens, sizes = trie.with_ends(pa.array([*texts, None, "unheard of"]))
    value, base, count = model.score(tokens, sizes)
    assert asked and all((np.diff(a) > 0).all() for a in asked)  # each one once, in the files' order
    assert sum(map(len, asked)) < len(tokens)
    at = 0
    for t, n in zip([*texts, None, "unheard of"], sizes.tolist(), strict=True):
        alone = model.score(*trie.with_ends(pa.array([t], pa.string())))
        assert [x.tolist() for x in alone] == [x[at : at + n].tolist() for x in (value, base, count)]
        at += n


def test_trie_query_keeps_ngrams_found_once(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    _, score, n, grams = brute_model([t for i, t in enumerate(texts) if not held_out(i)], least=1)
    assert sum(c == 1 for c in grams[2].values()) > 100
    for row in QUERIES["op7_ngram_trie"](spark, str(tmp_path)).collect():
        whole, base, known = score(texts[row.doc_id])
        assert row.held_out == held_out(row.doc_id) and row.train_tokens == n and row.n_known == known
        assert row.base_score == pytest.approx(base, abs=1e-6)
        assert row.score == pytest.approx(whole, abs=0.003 * row.n_tokens + 1e-6)


def test_trie_null_ids_repeated_rows_frequent_pairs(spark, tmp_path):
    rows = [(None, "a b c d"), (None, None), (3, "a b c d"), (3, "a b c d"), (4, "x y " * 400), (5, ""), (7, "a b")]
    rows += [(100 + i, f"a b w{i}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    _, score, n, grams = brute_model([t for i, t in rows if not held_out(i)], least=1)
    assert grams[1][b"a", b"b"] > 255 or grams[1][b"x", b"y"] > 255
    out = [r.asDict() for r in QUERIES["op7_ngram_trie"](spark, str(tmp_path)).collect()]
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(i or -1 for i, _ in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in out) == sorted((i or -1, len(low_words(t)) + 1) for i, t in rows)
    by_id = {i: t for i, t in rows if i is not None}
    for r in out:
        assert r["held_out"] == held_out(r["doc_id"]) and r["train_tokens"] == n
        if r["doc_id"] is not None:
            whole, base, known = score(by_id[r["doc_id"]])
            assert r["n_known"] == known and r["base_score"] == pytest.approx(base, abs=1e-6)
            assert r["score"] == pytest.approx(whole, abs=0.003 * r["n_tokens"] + 1e-6)


# importance resampling


def brute_weights(texts, good, buckets, smooth):
    """Log weights by the operator's formula, feature by feature."""
    from tidemark.llm.words import mix, word_hashes

    import pyarrow as pa

    def features(text):
        h, _ = word_hashes(pa.array([text], pa.string()))
        h = [int(x) for x in h]
        pairs = [int(mix(np.array([a * 3 + b & (2**64 - 1)], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        half = buckets // 2
        return Counter([x % half for x in h] + [x % half + half for x in pairs])

    own = [features(t) for t in texts]
    raw, target = Counter(), Counter()
    for f, g in zip(own, good, strict=True):
        raw.update(f)
        target.update(f if g else {})
    sums = lambda c, hi: sum(n for b, n in c.items() if (b >= buckets // 2) == hi)
    rate = {hi: (sums(target, hi) + 1) / (sums(raw, hi) + 1) for hi in (False, True)}
    return [sum(n * (math.log(target[b] - n * g + smooth) - math.log((raw[b] - n) * rate[b >= buckets // 2] + smooth)) for b, n in f.items()) for f, g in zip(own, good, strict=True)]


def test_resample_against_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", "  ", "one"] + [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    labels = [(i, int(i % 3 == 0), int(i % 9 == 0)) for i in range(len(texts)) if i % 2]
    good = [(i, 1, 0) in labels for i in range(len(texts))]
    got = resample.resample(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=1 << 12, share=0.25).collect()
    want = brute_weights(texts, good, 1 << 12, 3.0)
    keys = {x.id: x for x in spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "xxhash64(id, xxhash64(text), 0) AS h").collect()}
    noisy = {i: w - math.log(-math.log((((keys[i].h & (2**64 - 1)) >> 12) + 0.5) / 2.0**52)) for i, w in enumerate(want)}
    order = sorted(noisy, key=lambda i: -noisy[i])
    for x in got:
        assert math.isclose(x.r_log_weight, want[x.doc_id], abs_tol=1e-9)
        assert x.r_rank == order.index(x.doc_id) and x.r_kept == (x.r_rank < 11)


def test_resample_without_a_word(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op10_importance_resampling"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and {r.log_weight for r in got} == {0.0}


def test_resample(spark, tmp_path):
    texts = [(i, prose(i, 80) + (" junk idiot scum trash" * 6 if i % 5 == 0 else "")) for i in range(300)] + [(900, None), (901, ""), (902, prose(9, 5_000)), (None, prose(4, 60))]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.read.parquet(f"{tmp_path}/d").selectExpr("*", "1 as id", "2 as good", "3 as log_weight")
    got = resample.resample(docs, labels, buckets=1 << 16).collect()
    assert len(got) == len(texts) and sorted(r.r_rank for r in got) == list(range(len(texts)))
    kept = {r.doc_id: r.r_kept for r in got}
    assert not any(kept[i] for i in range(0, 300, 5)) and sum(kept[i] for i in range(300) if i % 5) >= 225
    assert all(r.r_log_weight == 0 for r in got if not r.text)
    assert sum(r.r_kept for r in resample.resample(docs, labels, share=0.25).collect()) == 76
    again = {(r.doc_id, r.r_rank) for r in resample.resample(docs, labels, buckets=1 << 16).collect()}
    assert again == {(r.doc_id, r.r_rank) for r in got}


# empty tables


def test_empty_tables(spark, empty, tokenizer, tmp_path):
    vocab, _ = tokenizer("byte_bpe_50k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(empty).count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert simple8b.read_ids(simple8b.write_ids(empty, f"file://{tmp_path}/e", vocab)).count() == 0
    assert packing.pack(empty, vocab).count() == 0
    assert shard.shard(empty, 4).count() == 0
    assert chunks.dedup_chunks(empty).count() == 0
    assert suffixes.dedup_substrings(empty).count() == 0
    assert jaccard.jaccard_join(empty).count() == 0
    assert resample.resample(empty, labels).count() == 0
    assert trie.score(empty, trie.build_model(empty.select("text"))).count() == 0


def test_no_labels_and_no_items(spark, stored):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.c_contaminated for r in decontaminate.decontaminate(stored, bench).collect())
    assert not any(r.r_kept for r in resample.resample(stored, labels).collect())


def test_words(spark):
    got = spark.createDataFrame([("a b\x0bc d\n",), (None,), ("",)], "t string").select(blank_words("t").alias("w")).collect()
    assert [r.w for r in got] == [["a", "b", "c d"], [], []]


class Ends:
    """What a sketch asks of the table of prefix sums, without Spark."""

    def __init__(self, ends):
        self.ends = ends


@pytest.mark.parametrize("cells", [2, 8, 64])
def test_sketch_finds_the_least_capacity(cells, monkeypatch):
    def refine(self, ends, which, cells):
        each, got = max(2, cells // len(which)), {}
        for i in which:
            lo, hi, found = self.at[i - 1], self.at[i], {}
            for e in (e for e in ends.ends if lo < e <= hi):
                found.setdefault((e - lo - 1) * each // (hi - lo), []).append(e)
            for x in found.values():
                got[max(x)] = len(x) - 1
                got[min(x)] = 1
        known = dict(zip(self.at, self.groups, strict=True))
        for i in which:
            known.pop(self.at[i])
        self.at, self.groups = map(list, zip(*sorted((known | got).items()), strict=True))

    monkeypatch.setattr(shard.Sketch, "refine", refine)
    r = random.Random(cells)
    for _ in range(60):
        sizes = [r.randrange(16, 90) * r.choice([1, 1, 1, 50]) for _ in range(r.randrange(1, 60))]
        ends = np.cumsum(sizes).tolist()

        def feasible(capacity, shards, sizes=sizes):
            used, at = 1, 0
            for n in sizes:
                used, at = (used + 1, n) if at + n > capacity else (used, at + n)
            return used <= shards

        for shards in (1, 2, 5, 9, 70):
            sketch = shard.Sketch(ends[-1], len(ends))
            capacity, _ = shard.search(sketch, Ends(ends), shards, max(sizes), cells)
            assert feasible(capacity, shards) and (capacity == max(max(sizes), -(-ends[-1] // shards)) or not feasible(capacity - 1, shards))
            cuts = [0, *shard.balanced(sketch, Ends(ends), shards, capacity, cells)]
            assert cuts[-1] == ends[-1] and set(cuts) <= {0, *ends} and max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= capacity
