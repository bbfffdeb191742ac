"""Languages of texts, span by span: scripts narrow the candidates, Viterbi with a price for each switch labels words.

A word is a run of letters of one script, 32 at most (longer runs are cut). The model counts, over all texts it may
learn from, hashed n-grams of 2, 3 and 4 letters of the words (their ends marked) for each language, and the letters
of each script. A language is a candidate for a word if at least ``least_share`` of its letters are of the word's
script; a script that no language has leaves all of them. A candidate's score of a word is the sum of its n-grams'
log likelihoods over 3, less the mean of the candidates; others get ``outside``. Viterbi finds the labels of greatest
sum of scores less ``penalty`` for each change of language; words of one label in a row are a span. The language of
a text is that of the most letters (ties: the first name), and its score is their share of all letters times
the language's probability against the others by the words of its spans.

The counting tasks send one row for each language and n-gram they found; the model has ``buckets`` numbers for each
language (at most ``most_langs``, else an error), and is held by the driver and the workers. Its size doesn't grow
with the documents. Viterbi runs over whole texts, in blocks of words side by side: the best sums from each label before a
block to each label after it first, then the documents' blocks in their order, then the words in the blocks.

Defined results: null, empty and letterless texts are ``und`` with score 0 and no spans, and so is every text if
nothing could be learnt; rows without language, id or text teach nothing; a null id isn't held out; repeated rows
count as often as they stand there and each gets its row; an empty table gives no rows. Columns of ``docs`` are carried
along; a column that is called like a result (``g_lang``, ``g_score``, ``g_spans``) is an error told by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, table
from tidemark.llm.words import mix

#: Blocks of Unicode whose code points are letters of a script, or its marks inside words.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6),
    ("latin", 0xF8, 0x24F), ("latin", 0x300, 0x36F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x587), ("hebrew", 0x591, 0x5F4), ("arabic", 0x620, 0x6D3), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x963), ("bengali", 0x980, 0x9E3), ("gurmukhi", 0xA01, 0xA63), ("gujarati", 0xA81, 0xAE3), ("tamil", 0xB82, 0xBD7),
    ("telugu", 0xC00, 0xC63), ("kannada", 0xC80, 0xCE3), ("malayalam", 0xD00, 0xD63), ("sinhala", 0xD81, 0xDDF), ("thai", 0xE01, 0xE4E),
    ("lao", 0xE81, 0xECD), ("tibetan", 0xF40, 0xFBC), ("myanmar", 0x1000, 0x103F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137C), ("khmer", 0x1780, 0x17D3), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x2FA1F),
)
NAMES = ["none", "other", *dict.fromkeys(s[0] for s in SCRIPTS)]
ORDERS = (2, 3, 4)
LONGEST = 32
SPANS = "array<struct<start:long,end:long,lang:string>>"


def script_table():
    """The script of every code point, as its place in NAMES; letters of no listed block are ``other``."""
    import numpy as np

    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for name, first, last in SCRIPTS:
        at = slice(first, last + 1)
        out[at] = NAMES.index(name)
    return out


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


@dataclass
class Words:
    """The words of some texts: the code points (lower case), and of each word its text, place in it, length and script."""

    points: object
    begin: object
    size: object
    text: object
    start: object
    script: object


def words_of(texts: list[str | None], scripts) -> Words:
    import numpy as np

    low = [lowered(t or "") for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = scripts[np.minimum(points, 0x10FFFF)]
    new = np.empty(len(kind), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    size = np.diff(np.append(runs, len(kind)))
    letters = kind[runs] > 0
    runs, size = runs[letters], size[letters]
    pieces = -(-size // LONGEST)
    if len(size) and pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        runs, whole = np.repeat(runs, pieces) + k * LONGEST, np.repeat(size, pieces)
        size = np.minimum(LONGEST, whole - k * LONGEST)
    firsts = np.cumsum([0] + [len(t) + 1 for t in low])
    of = np.searchsorted(firsts, runs, side="right") - 1
    return Words(points, runs, size, of, runs - firsts[of], kind[runs].astype(np.int64))


def unlike(words: Words):
    """Of words that are spelt alike one each: their places, and for each word the number of its spelling."""
    import numpy as np

    spread = np.cumsum(words.size) - words.size
    place = np.arange(words.size.sum()) - np.repeat(spread, words.size)
    points = words.points[np.repeat(words.begin, words.size) + place].astype(np.uint64)
    power = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    hashes = np.add.reduceat(mix(points + np.uint64(1)) * power[place], spread) if len(spread) else np.zeros(0, np.uint64)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return first, number


def grams(words: Words, chosen, buckets: int):
    """Buckets of the n-grams of the chosen words, and for each the chosen word's number, in its order."""
    import numpy as np

    size = words.size[chosen] + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - first[word]
    inner = (place > 0) & (place < size[word] - 1)
    padded = np.zeros(len(word), np.uint64)
    padded[inner] = words.points[words.begin[chosen][word[inner]] + place[inner] - 1]
    found, of = [], []
    for n in ORDERS:
        held = size - n + 1
        held = np.maximum(held, 0)
        at = np.repeat(first, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[at + j]
        found.append((mix(h) % np.uint64(buckets)).astype(np.int64))
        of.append(np.repeat(np.arange(len(size)), held))
    return np.concatenate(found), np.concatenate(of)


def counts(learn: DataFrame, buckets: int, scripts) -> DataFrame:
    """``learn`` has ``text`` and ``lang``; rows of ``lang``, ``bucket`` (from ``buckets`` on: the scripts), ``n``."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[str, object] = {}

        def rows():
            for lang, sums in held.items():
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some])], ["lang", "bucket", "n"])
            held.clear()

        for b in by_bytes(batches, 0, 1 << 20):
            langs = b.column(1).to_pylist()
            texts = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                words = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang], scripts)
                if not len(words.size):
                    continue
                if lang not in held:
                    if len(held) >= 32:
                        yield from rows()
                    held[lang] = np.zeros(buckets + len(NAMES), np.int64)
                chosen, number = unlike(words)
                often = np.bincount(number)
                found, of = grams(words, chosen, buckets)
                held[lang][:buckets] += np.bincount(found, often[of], buckets).astype(np.int64)
                held[lang][buckets:] += np.bincount(words.script, words.size, len(NAMES)).astype(np.int64)
        yield from rows()

    return learn.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    #: [buckets, languages]: log likelihood over the number of orders
    weights: object
    #: [scripts, languages]: whether the language is a candidate
    candidate: object
    scripts: object


def fit(learn: DataFrame, buckets: int = 1 << 17, least_share: float = 0.005, smooth: float = 0.5, most_langs: int = 400) -> Model:
    """The model of the rows (``text``, ``lang``)."""
    import numpy as np

    scripts = script_table()
    learn = learn.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r[0] for r in learn.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    got = counts(learn, buckets, scripts).toArrow()  # at most languages x (buckets + scripts) rows
    sums = np.zeros((buckets + len(NAMES), len(langs)))
    column = {x: i for i, x in enumerate(langs)}
    if got.num_rows:
        code = got["lang"].combine_chunks().dictionary_encode()
        where = np.array([column[x] for x in code.dictionary.to_pylist()])[code.indices.to_numpy()]
        sums[got["bucket"].to_numpy(), where] = got["n"].to_numpy()
    known = sums[buckets:].sum(axis=0) > 0
    langs, sums = [x for x, k in zip(langs, known, strict=True) if k], sums[:, known]
    letters = sums[buckets:]
    candidate = letters >= least_share * letters.sum(axis=0)
    candidate &= letters > 0
    candidate[~candidate.any(axis=1)] = True
    part = sums[:buckets] + smooth
    weights = (np.log(part) - np.log(part.sum(axis=0))) / len(ORDERS) if langs else part
    return Model(langs, weights.astype(np.float32), candidate, scripts)


def word_scores(words: Words, model: Model, outside: float):
    """[words, languages]: each word's scores, as the module says."""
    import numpy as np

    wide = len(model.langs)
    if not len(words.size):
        return np.zeros((0, wide), np.float32)
    chosen, number = unlike(words)
    found, of = grams(words, chosen, model.weights.shape[0])
    score = np.stack([np.bincount(of, model.weights[found, j], len(chosen)) for j in range(wide)], axis=1)
    may = model.candidate[words.script[chosen]]
    score -= (np.where(may, score, 0).sum(axis=1) / may.sum(axis=1))[:, None]
    return np.where(may, score, outside).astype(np.float32)[number]


def viterbi(score, sizes, penalty: float, block: int = 64):
    """The labels of greatest sum; ``sizes``: the numbers of words of the texts, one after another."""
    import numpy as np

    n, wide = score.shape
    labels = np.zeros(n, np.int64)
    if wide < 2 or not n:
        return labels
    sizes = sizes[sizes > 0]
    per = -(-sizes // block)
    text = np.repeat(np.arange(len(sizes)), per)
    turn = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + turn * block
    length = np.minimum(block, np.repeat(sizes, per) - turn * block)
    order = np.argsort(-length, kind="stable")  # blocks that still run at a step stand first
    start, length = start[order], length[order]
    running = np.searchsorted(-length, -np.arange(1, block + 1), side="right")
    # From each label before a block to each after it.
    best = np.full((len(start), wide, wide), -1e30, np.float32)
    best[:, np.arange(wide), np.arange(wide)] = 0
    for t in range(block):
        if not (k := running[t]):
            break
        part = best[:k]
        np.maximum(part, part.max(axis=2, keepdims=True) - penalty, out=part)
        part += score[start[:k] + t][:, None, :]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # Blocks of a text in their order; texts side by side.
    by_text = np.argsort(-per, kind="stable")
    first, most = (np.cumsum(per) - per)[by_text], per[by_text]
    sums = np.zeros((len(sizes), wide))
    before = np.zeros((len(start), wide), np.int64)
    live = np.searchsorted(-most, -np.arange(1, most[0] + 1), side="right")
    for b in range(int(most[0])):
        k = live[b]
        at = place[first[:k] + b]
        all_ways = sums[:k, :, None] + best[at]
        before[at] = all_ways.argmax(axis=1)
        new = all_ways.max(axis=1)
        sums[:k] = new - new.max(axis=1, keepdims=True)
    last = sums.argmax(axis=1)
    enter, leave = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for b in range(int(most[0]) - 1, -1, -1):
        k = live[b]
        at = place[first[:k] + b]
        leave[at] = last[:k]
        enter[at] = before[at, last[:k]]
        last[:k] = enter[at]
    # Words of a block, now that the label before it is known.
    now = np.full((len(start), wide), -1e30, np.float32)
    now[np.arange(len(start)), enter] = 0
    back = np.zeros((block, len(start), wide), np.uint16)
    own = np.arange(wide, dtype=np.uint16)
    for t in range(block):
        if not (k := running[t]):
            break
        top = now[:k].argmax(axis=1)
        other = now[np.arange(k), top] - penalty
        back[t, :k] = np.where(now[:k] >= other[:, None], own, top[:, None])
        now[:k] = np.maximum(now[:k], other[:, None]) + score[start[:k] + t]
    for t in range(block - 1, -1, -1):
        if k := running[t]:
            labels[start[:k] + t] = leave[:k]
            leave[:k] = back[t, np.arange(k), leave[:k]]
    return labels


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 8.0, outside: float = -20.0) -> DataFrame:
    """``docs`` with ``g_lang``, ``g_score`` and ``g_spans`` (code points of the text, end not included; their language)."""
    if clash := {"g_lang", "g_score", "g_spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    held = spark.sparkContext.broadcast(model)
    names = docs.columns

    def label(batches):
        import numpy as np
        import pyarrow as pa

        model = held.value
        langs, wide = model.langs, len(model.langs)
        for b in by_bytes(batches, place, max(1 << 16, (32 << 20) // max(16, wide * wide))):
            words = words_of(b.column(place).to_pylist(), model.scripts)
            if not wide:
                words = words_of([], model.scripts)
            score = word_scores(words, model, outside)
            sizes = np.bincount(words.text, minlength=b.num_rows)[: b.num_rows]
            labels = viterbi(score, sizes, penalty)
            letters = np.bincount(words.text * max(wide, 1) + labels, words.size, b.num_rows * max(wide, 1)).reshape(b.num_rows, -1)
            lang = letters.argmax(axis=1)
            some = letters.sum(axis=1) > 0
            share = letters[np.arange(b.num_rows), lang] / np.maximum(letters.sum(axis=1), 1)
            if wide:
                own = labels == lang[words.text]
                total = np.stack([np.bincount(words.text[own], score[own, j], b.num_rows) for j in range(wide)], axis=1)
                rest = np.exp(np.clip(total - total[np.arange(b.num_rows), lang][:, None], -700, 50)).sum(axis=1)
                share = share / np.maximum(rest, 1)
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(labels)) - 1 if len(heads) else heads
            offsets = np.concatenate([[0], np.cumsum(np.bincount(words.text[heads], minlength=b.num_rows))])[: b.num_rows + 1]
            listed = pa.array(langs or ["und"], pa.string())
            spans = pa.StructArray.from_arrays([pa.array(words.start[heads]), pa.array((words.start + words.size)[tails]), listed.take(pa.array(labels[heads]))], ["start", "end", "lang"])
            said = pa.array([langs[x] if s else "und" for x, s in zip(lang, some, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said, pa.array(np.where(some, share, 0.0)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)], [*names, "g_lang", "g_score", "g_spans"])

    schema = docs.limit(0).withColumns({"g_lang": F.lit("").cast("string"), "g_score": F.lit(0.0), "g_spans": F.lit(None).cast(SPANS)}).schema
    return docs.mapInArrow(label, schema)


def remainder(id_col: str, modulus: int = 4) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op11_language_spans(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose remainder isn't 2; labels all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder("doc_id") != 2))
    out = identify(docs.select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id") == 2, F.lit(False))), model)
    return out.select("doc_id", "held_out", F.col("g_lang").alias("lang_pred"), F.col("g_score").alias("score"), F.size("g_spans").cast("long").alias("n_spans"))
