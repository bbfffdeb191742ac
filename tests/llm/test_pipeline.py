"""The pipeline's stages on planted cases, each judged on its own input."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, near_copies, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    r = random.Random(8)
    passage = prose(900, 60)
    items = [(i, prose(i, 150)) for i in range(60)]
    items += [(100 + i, t) for i, t in enumerate(near_copies(7_000, 8, 200, 4))] + [(120 + i, prose(5, 150)) for i in range(3)]
    items += [(200 + i, f"{prose(300 + i, 80)} {passage} {prose(400 + i, 80)}") for i in range(6)]
    items += [(300, "spam spam spam " * 40), (301, "too short"), (302, None), (303, ""), (None, prose(777, 100))]
    leak = prose(555, 30)
    items += [(400, f"{prose(601, 90)} {leak.upper()} {prose(602, 90)}")]
    r.shuffle(items)
    docs = spark.createDataFrame([(d, t, "en", r.choice("ab"), None if t is None else len(t)) for d, t in items], SCHEMA)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    frames = {"documents": spark.read.parquet(f"{top}/documents.parquet")}
    last = frames["documents"]
    for name, f in corpus_pipeline.STAGES:
        f(spark, last, str(top)).write.parquet(f"{top}/out-{name}")
        frames[name] = last = spark.read.parquet(f"{top}/out-{name}")
    return frames, str(top)


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(staged):
    frames, _ = staged
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert frames[name].dtypes == frames["documents"].dtypes
        assert all(r.n_chars == len(r.text) for r in frames[name].collect())


def test_rejects(staged):
    frames, _ = staged
    assert set(texts(frames["documents"])) - set(texts(frames["quality_rules"])) == {300, 301, 302, 303}


def test_one_of_each_group(staged):
    frames, _ = staged
    before = texts(frames["quality_rules"])
    want = {d for d, (_, least) in ((k[0], v) for k, v in brute_components(list(before.items())).items()) if d == least}
    assert set(texts(frames["near_duplicates"])) == want and {5, 100} <= want and not {120, 121, 122} & want


def test_null_and_repeated_ids_leave_one_of_each_group(spark, tmp_path):
    groups = [list(near_copies(9_000 + 100 * i, 4, 200, 1)) for i in range(4)]
    ids = [[None] * 4, [7] * 4, [9, 9, None, 11], [13, 12, 12, 12]]
    items = [(d, t) for texts, names in zip(groups, ids, strict=True) for d, t in zip(names, texts, strict=True)]
    items += [(20, prose(71, 90)), (20, prose(72, 90)), (None, prose(73, 90)), (None, prose(74, 90)), (None, ""), (None, None)]
    items += [(None, groups[0][0]), (7, groups[1][0])]
    rows = [(d, t, "en", "a", None if t is None else len(t)) for d, t in items]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/d")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()]
    assert [sorted({d for d, t in left if t in texts}, key=str) for texts in groups] == [[None], [7], [9], [12]]
    assert [sum(t in texts for _, t in left) for texts in groups] == [1, 1, 1, 1]
    assert sorted((x for x in left if x[1] not in sum(groups, [])), key=str) == sorted(items[16:22], key=str)


def test_passage_stays_once(staged):
    frames, _ = staged
    before, after = texts(frames["near_duplicates"]), texts(frames["substring_dedup"])
    assert set(before) == set(after)
    shorter = {d for d in before if len(after[d]) < len(before[d])}
    assert shorter == set(range(201, 206))
    assert all(len(before[d]) - len(after[d]) > 150 for d in shorter)


def test_leak_goes(staged):
    frames, _ = staged
    assert set(texts(frames["substring_dedup"])) - set(texts(frames["decontamination"])) == {400}


def test_all_is_packed(staged):
    frames, _ = staged
    assert {r.doc_id for r in frames["packing"].collect()} == set(texts(frames["decontamination"]))


def test_run_is_the_stages(spark, staged):
    frames, top = staged
    key = lambda f: sorted(f.select("doc_id", "piece", "start", "length", "ids_crc32").collect(), key=str)
    assert key(corpus_pipeline.run(spark, top)) == key(frames["packing"])


CLASHES = ["__id", "__key", "q_text", "q_kept", "x_text", "c_text", "c_contaminated", "k_own", "lost", "cells", "id", "key", "first", "__0"]


def test_columns_with_clashing_names(spark, staged):
    from pyspark.sql import functions as F

    frames, top = staged
    docs = frames["documents"].select("*", *[(F.col("doc_id") + i).alias(c) for i, c in enumerate(CLASHES)])
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, top).write.parquet(f"{top}/clash-{name}")
        docs = spark.read.parquet(f"{top}/clash-{name}")
        assert docs.columns == [*frames["documents"].columns, *CLASHES]
        assert sorted(texts(docs), key=str) == sorted(texts(frames[name]), key=str)
        assert all(r[c] == (None if r.doc_id is None else r.doc_id + i) for r in docs.collect() for i, c in enumerate(CLASHES))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
