"""Languages, whitening and vector codes against brute force, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tidemark.llm import langid, veccodes, whiten
from tidemark.llm.registry import QUERIES

# languages

SYLLABLES = {"xx": "ba do ke mi nu la".split(), "yy": "stra chk wurz pfl ung".split(), "ru": "при вет мир дом ска".split()}


def speech(lang: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def learnt(spark):
    rows = [(speech(x, i, 60), x) for x in SYLLABLES for i in range(20)] + [(None, "xx"), ("no language", None), ("", "yy"), ("12 34", "digits")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"), buckets=1 << 14)


def test_model(learnt):
    assert learnt.langs == ["ru", "xx", "yy"]  # no letters, no language
    latin, cyrillic = (learnt.candidate[langid.NAMES.index(x)] for x in ("latin", "cyrillic"))
    assert latin.tolist() == [False, True, True] and cyrillic.tolist() == [True, False, False]
    assert learnt.candidate[langid.NAMES.index("thai")].all()


def test_counts_are_those_of_all_words(spark):
    rows = [(speech("xx", i, 40) + " Ünï " + "q" * 70, "a" if i % 3 else "b") for i in range(12)]
    got = {(r["lang"], r["bucket"]): r["n"] for r in langid.counts(spark.createDataFrame(rows, "text string, lang string").repartition(3), 1 << 12, langid.script_table()).collect()}
    want = Counter()
    for text, lang in rows:
        for run in text.lower().split():
            for at in range(0, len(run), langid.LONGEST):
                points = [0, *map(ord, run[at : at + langid.LONGEST]), 0]
                want[lang, (1 << 12) + langid.NAMES.index("latin")] += len(points) - 2
                for n in langid.ORDERS:
                    for i in range(len(points) - n + 1):
                        h = n
                        for p in points[i : i + n]:
                            h = (h * 0x9E3779B97F4A7C15 + p) % 2**64
                        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
                        want[lang, (h ^ (h >> 31)) % (1 << 12)] += 1
    assert got == dict(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(1, 3), st.integers(0, 99), st.sampled_from([1, 2, 5]))
def test_viterbi(sizes, wide, seed, block):
    score = np.random.default_rng(seed).integers(-3, 4, (sum(sizes), wide)).astype(np.float32) + np.random.default_rng(seed).random((sum(sizes), wide)).astype(np.float32) / 8
    got, at = langid.viterbi(score, np.array(sizes), 1.5, block), 0
    worth = lambda path, part: sum(part[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
    for n in sizes:
        part = score[at : at + n].astype(float)
        if wide**n <= 3**7:
            best = max(worth(p, part) for p in itertools.product(range(wide), repeat=n))
        else:  # the plain recurrence
            now = part[0]
            for row in part[1:]:
                now = np.maximum(now, now.max() - 1.5) + row
            best = now.max()
        assert math.isclose(worth(got[at : at + n].tolist(), part), best, abs_tol=1e-3)
        at += n


def test_spans_of_mixed_text(spark, learnt):
    one, two, three = speech("xx", 901, 30), speech("yy", 902, 25), speech("ru", 903, 10)
    text = f"  {one}, {two}! {three} 12"
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), learnt).first()
    assert [(text[s.start : s.end], s.lang) for s in row.g_spans] == [(one, "xx"), (two, "yy"), (three, "ru")]
    share = {x: sum(c.isalpha() for c in t) for x, t in (("xx", one), ("yy", two), ("ru", three))}
    assert row.g_lang == max(share, key=share.get)
    assert math.isclose(row.g_score, max(share.values()) / sum(share.values()), rel_tol=1e-3)


def test_identify_odd_rows(spark, learnt):
    rows = [(None, None, 1), (1, "", 2), (2, " 12 ,. ", 3), (3, speech("yy", 7, 40_000), 4), (4, speech("ru", 8, 3), 5), (4, speech("ru", 8, 3), 5), (5, "İİ " + speech("xx", 9, 20), None), (6, "漢字かな", 1), (7, "x" * 5_000, 1), (8, "\x00\n\n", 1)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang int").repartition(2), learnt)
    assert out.columns == ["doc_id", "text", "lang", "g_lang", "g_score", "g_spans"]
    got = out.collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got if r.doc_id) == sorted(r for r in rows if r[0])
    by = {r.doc_id: r for r in got}
    assert [by[k].g_lang for k in (None, 1, 2, 8)] == ["und"] * 4 and by[2].g_score == 0 and by[1].g_spans == []
    assert (by[3].g_lang, by[4].g_lang, by[5].g_lang) == ("yy", "ru", "xx") and by[6].g_lang in learnt.langs
    assert all(0 <= r.g_score <= 1 for r in got)
    assert sum(r.doc_id == 4 for r in got) == 2
    with pytest.raises(ValueError, match="g_lang"):
        langid.identify(out, learnt)


def test_nothing_learnt(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.identify(none, model).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), model).first().g_lang == "und"


def test_op11(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(9_000_001, None, "en", "s", 1), (9_000_002, "123", None, None, None), (None, "the and of the", "en", "s", 1), (9_000_003, "", "zz", "s", 0)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_language_spans"](spark, str(tmp_path)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth) + 4
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 20
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = {r.doc_id: r for r in got}
    assert odd[9_000_001].lang_pred == odd[9_000_002].lang_pred == odd[9_000_003].lang_pred == "und" and odd[None].lang_pred == "en"


# whitening


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 999), st.integers(0, 3))
def test_inertia(d, seed, zeros):
    r = np.random.default_rng(seed)
    a = r.integers(-3, 4, (d, d)).astype(float)
    a = a + a.T
    if zeros:
        a[np.arange(d), np.arange(d)] = 0
    e = np.linalg.eigvalsh(a)
    if np.abs(e).min() > 1e-6:
        assert whiten.negative_pivots(a) == (e < 0).sum()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 999), st.sampled_from(["plain", "twins", "close", "rank"]))
def test_leading(d, seed, kind):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    e = np.sort(r.random(d) * 100 + 1)[::-1]
    if kind == "twins" and d > 2:
        e[1] = e[0]
    if kind == "close" and d > 2:
        e[1] = e[0] * (1 - 1e-9)
    if kind == "rank":
        e[d // 2 :] = 0
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whiten.leading(a, 5)
    want = [x for x in e[:5] if x > 0]
    assert np.allclose(values, want, rtol=1e-9) and len(values) == len(want)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-9 * 100


VECTORS = "vec_id long, embedding array<float>, label int, id int, d string, n int, vector string"


def vectors(n: int, d: int, seed: int = 0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d)) * np.linspace(2, 0.3, d)
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3) if i % 5 else None) for i, v in enumerate(base)]
    rows += [rows[3], rows[3], (None, rows[1][1], 1), (2, rows[0][1], None)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * (d - 1), 2), (903, [float("nan")] + [0.0] * (d - 1), 2), (904, [float("-inf")] * d, 2), (905, [None] + [0.5] * (d - 1), 2)]
    return rows, [(*x, 1, "x", None, "y") for x in rows + bad]


@pytest.mark.parametrize(("n", "d"), [(60, 16), (5, 8), (40, 3)])
def test_whiten(spark, n, d):
    good, rows = vectors(n, d)
    got = whiten.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in good]
    m, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(m * a - b) / m for a, b in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / m)
    wide = min(8, d, n - 1)
    assert len(got) == m * wide and {r.n for r in got} == {m} and max(r.identity_error for r in got) < 1e-9
    want = defaultdict(list)
    for (i, _, _), r, y in zip(good, x, centred @ u[:, ::-1][:, :wide] / np.sqrt(e[::-1][:wide]), strict=True):
        want[i].append((sum((m * a - b) ** 2 for a, b in zip(r, s, strict=True)), y))
    seen = defaultdict(list)
    for r in got:
        assert int(r.deviation) in [w[0] for w in want[r.id]]
        assert math.isclose(r.explained, e[::-1][r.component - 1] / e.sum(), rel_tol=1e-9)
        seen[r.component].append((str(r.id), abs(r.whitened)))
    for k in range(wide):
        assert np.allclose([v for _, v in sorted(seen[k + 1])], [v for _, v in sorted((str(i), abs(y[k])) for i, ys in want.items() for _, y in ys)], atol=1e-8)


def test_whiten_without_spread(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whiten.whiten(empty).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1, 1, "", 1, "")] * 4, VECTORS)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, 1, 1, "", 1, "")], VECTORS)).count() == 0


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        whiten.whiten(spark.createDataFrame([(1, [1e30, 0.0], 1, 1, "", 1, "")], VECTORS)).count()


def test_op12(spark):
    got = QUERIES["op12_spectrum_whitening"](spark, SF_SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = got.collect()
    assert len(rows) == 8 * spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count() and rows[0].identity_error < 1e-9


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    x = [([math.floor(4096 * c) for c in v], i, label) for i, v, label in rows]
    w = len(x[0][0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(zip(x, rows, strict=True), key=lambda r: (r[0][1] is None, r[0][1] or 0, r[1][1]))[:entries]
    books = [[cut(v, p) for (v, _, _), _ in first] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def assign():
        return [[min((far(cut(v, p), b), k) for k, b in enumerate(books[p])) for p in range(parts)] for v, _, _ in x]

    for _ in range(rounds):
        of, new = assign(), [list(b) for b in books]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (v, _, _), a in zip(x, of, strict=True) if a[p][1] == k]
                if own:
                    new[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    out = [(i, "".join(f"{k:02x}" for _, k in a), sum(e for e, _ in a), label) for (_, i, label), a in zip(x, assign(), strict=True)]
    sums = Counter()
    for r in out:
        sums[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), code, error, sums[label], digest) for i, code, error, label in out)


@pytest.mark.parametrize(("n", "d"), [(90, 16), (6, 8)])
def test_op13(spark, tmp_path, n, d):
    good, rows = vectors(n, d, 5)
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_dictionary_codes"](spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(good)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_change_nothing(spark, block):
    good, rows = vectors(50, 8, 6)
    frame = spark.createDataFrame(rows, VECTORS)
    books, coded = veccodes.encode(frame, block=block)
    more, other = veccodes.encode(frame)
    assert (books == more).all() and sorted(map(str, coded.collect())) == sorted(map(str, other.collect()))
    assert coded.count() == len(good)


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1, 1, "", 1, "")], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op13_dictionary_codes"](spark, str(tmp_path)).count() == 0
    assert QUERIES["op12_spectrum_whitening"](spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="divide"):
        veccodes.encode(spark.createDataFrame([(1, [1.0] * 9, 1, 1, "", 1, "")], VECTORS))
