"""N-gram Jaccard join by a partition of the shingles' universe and the pigeonhole principle, verified exactly.

Two documents link when their sets of distinct shingles have a Jaccard similarity of at least ``percent``. The steps:

1. *Sets.* Each document's set is hashed (64 bits a shingle); equal sets are one class from here on.
2. *Shared shingles.* A shingle that only one class holds is in no intersection. Where over ``100 - percent``
   per cent of a set is such, the document can't link. Half of the universe is counted, which bounds the same
   share from below; packed by hash range, each range counted by one task.
3. *Segments.* Sizes lie in bands, each so wide that partners are in the same or the next one. For a band
   the universe is dealt by hash into segments, more than the shingles two partners in it can differ by, so
   partners agree in a segment. All filled segments of a document are indexed, in small sets also their
   one-deletion neighbourhoods; probed are as many as the principle needs, those of the shortest lists (a
   filled segment that agrees counts one, one that may differ by a shingle two, an empty one nothing). A set
   whose segments don't suffice is compared by its single shingles instead.
4. *Links.* A list may be as long as the corpus. In a turn each list names one pivot, the member that shares most,
   and members of other components are verified against it; a list that lies in one component is done. What
   is left is compared in blocks of bounded size by short forms of the sets, never within a component, and
   only pairs that these can't rule out are verified.

Components are found by joins: the least label among neighbours, until nothing changes.

Defined results: null and blank texts have empty sets and link with nothing; rows alike in id and text are one
document, with a row each; null ids are reached but never name a component unless all in it are null; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, staged, table
from tidemark.llm.exchange import UNIT_BYTES, arrays, meet, parts, ranges_of, split_by_range, unit_name
from tidemark.llm.words import mix, shingle_hashes, word_hashes


def shingle_sets(texts, k: int):
    """Sorted distinct shingle hashes of a batch's texts, one after the other, and their numbers."""
    import numpy as np

    h, n = shingle_hashes(*word_hashes(texts), k)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(n))


def set_digests(h, n) -> list[bytes]:
    from xxhash import xxh3_128_digest

    data, out, at = memoryview(h.tobytes()), [], 0
    for size in n.tolist():
        out.append(xxh3_128_digest(data[8 * at : 8 * (at + size)]) if size else b"")
        at += size
    return out


def alone(blobs: list[bytes]) -> list[bytes]:
    """Of one range of hashes: how many of each document's no other class holds."""
    import numpy as np

    rows = [parts(x) for x in blobs]  # hashes (5 bytes each), each document's number of them, its class
    low = np.concatenate([r[0] for r in rows])
    value = np.zeros((len(low), 8), np.uint8)
    value[:, :5] = low
    value = value.view("<u8")[:, 0]
    counts = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(counts)), counts)
    name = np.concatenate([r[2] for r in rows])[doc]
    order = np.argsort(value, kind="stable")
    v, m = value[order], name[order]
    mine = np.zeros(len(counts), np.uint32)
    if len(v):
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        one = np.minimum.reduceat(m, edge) == np.maximum.reduceat(m, edge)
        one = np.repeat(one, np.diff(np.concatenate([edge, [len(v)]])))
        mine = np.bincount(doc[order[one]], minlength=len(counts)).astype(np.uint32)
    ends = np.cumsum([len(r[1]) for r in rows])
    return [mine[e - len(r[1]) : e].tobytes() for e, r in zip(ends, rows, strict=True)]


def sets_and_shares(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` has ``id``, ``key``, ``text``. One row for each of its rows: ``id``, ``key``, ``n``, ``digest``, ``may``:
    whether enough of the set is in other classes' sets too, and ``score``: how much, in thousandths."""
    ranges = ranges_of(docs.sparkSession)
    top = ranges.bit_length() - 1
    kind = docs.schema["id"].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in by_bytes(batches, 2, UNIT_BYTES):
            h, n = shingle_sets(b.column(2), k)
            digests = set_digests(h, n)
            names = np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)
            of = np.repeat(np.arange(len(n)), n)
            half = (h & np.uint64(1)) == 0  # half of the universe
            h, of = h[half], of[half]
            order, cut = split_by_range(h, ranges)
            h, of = h[order], of[order]
            low = ((h >> np.uint64(64 - top - 40)) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows = [arrays(low[cut[r] : cut[r + 1]].copy(), np.bincount(of[cut[r] : cut[r + 1]], minlength=len(n)).astype(np.uint32), names) for r in range(ranges)]
            keys, ids = np.asarray(b.column(1)), b.column(0).to_pylist()
            unit = unit_name(keys)
            columns = [[unit] * (ranges + 1), [*range(ranges), -1], [*rows, None], [None] * ranges + [arrays(ids, keys, n, digests)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["unit", "range", "data", "own"])

    id_type = {"bigint": "int64", "int": "int32", "string": "string"}.get(kind)
    if id_type is None:
        raise TypeError(f"ids of type {kind}")

    def gather(unit, own, answers):
        import numpy as np
        import pyarrow as pa

        ids, keys, n, digests = parts(own)
        single = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in answers)
        may = (n > 0) & (100 * (n - single) >= percent * n)
        score = (1000 * (n - single) // np.maximum(n, 1)).astype(np.int32)
        columns = [pa.array(ids, id_type), pa.array(keys), pa.array(n.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(may), pa.array(score)]
        return pa.table(columns, ["id", "key", "n", "digest", "may", "score"])

    packed = docs.mapInArrow(pack, "unit long, range int, data binary, own binary")
    return meet(packed, alone, gather, f"id {kind}, key long, n int, digest binary, may boolean, score int")


class Bands:
    """Bands of sizes, their segments, and the most that partners can differ by."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1, 2]
        while self.low[-1] < 1 << 40:
            self.low.append(-(-self.low[-1] * 100 // percent) + 1)

    def of(self, n: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.low, n) - 1

    def differ(self, r: int, s: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return r + s - 2 * -(-self.percent * (r + s) // (100 + self.percent))

    def most(self, n: int, band: int) -> int:
        """The most that a set of ``n`` can differ by from a partner, the larger of both being in ``band``.

        It grows with the sum of both sizes but for its remainder, so the largest sums are looked through.
        """
        top = max(n, min(self.low[band + 1] - 1, n * 100 // self.percent))
        least = -(-n * self.percent // 100)
        return max(self.differ(n, s) for s in range(max(least, top - 8), top + 1))

    def segments(self, band: int) -> int:
        return 3 * (self.most(self.low[band + 1] - 1, band) + 1) // 2


#: Sets of up to this many shingles also index one-deletion neighbourhoods.
DELETIONS_UPTO = 64


def signatures(h, bands: Bands, band: int, delete_upto: int = DELETIONS_UPTO):
    """Rows ``(list, spare)`` of one set in one band, and whether its segments suffice.

    ``list``: a hash of band, segment, kind (whole, or one shingle less) and contents. ``spare``: how many of the
    set's filled segments need no probe; -1 in rows that are only indexed.
    """
    import numpy as np

    m, need = bands.segments(band), bands.most(len(h), band) + 1
    seed = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    mixed = mix(h ^ seed)
    seg = (mixed % np.uint64(m)).astype(np.int64)
    value = mix(mixed + np.uint64(1))
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    sizes = np.diff(np.concatenate([edge, [len(seg)]]))
    sums = np.add.reduceat(value, edge)
    tag = mix(seg[edge].astype(np.uint64) * np.uint64(4) + seed)
    whole, less = mix(sums ^ tag), mix(sums ^ tag ^ np.uint64(1))  # lists of whole segments, and of those one shingle short of them
    filled = len(edge)
    # With too few filled segments each that may differ by a shingle counts for two (not one of a single shingle: the
    # partner's might be empty, and empty ones aren't indexed).
    order = np.argsort(sizes, kind="stable")
    several = order[sizes[order] > 1]
    twice = several[: max(0, need - filled)]
    rows = [(whole, max(0, filled - need))]
    small = bands.low[band] <= delete_upto
    enough = filled >= need or (small and filled + len(several) >= need)
    if small:
        owner = np.repeat(np.arange(filled), sizes)
        short = sums[owner] - value
        rows.append((mix(short ^ tag[owner] ^ np.uint64(1)), -1))  # this segment less one
        if enough and len(twice):
            rows.append((less[twice], 0))  # the partner's segment less one is mine
            mine = np.isin(owner, twice)
            rows.append((mix(short[mine] ^ tag[owner[mine]]), 0))  # mine less one is the partner's
    return np.concatenate([r for r, _ in rows]), np.concatenate([np.full(len(r), spare) for r, spare in rows]), enough


def similar(a, b, percent: int) -> bool:
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets link. Each pair goes with one set to the other one's place."""

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            of = [[np.frombuffer(x, "<u8") for x in b.column(i).to_pylist()] for i in (2, 3)]
            yes = pa.array([similar(x, y, percent) for x, y in zip(*of, strict=True)], pa.bool_())
            yield b.select([0, 1]).filter(yes)

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb")), "b")
    fits = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "ta", "tb")
    return fits.mapInArrow(check, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``label`` for each node of a link: labels fall to the least among neighbours, then to the label of
    the label, until no row changes. A node's neighbours combine before the shuffle."""
    ways = staged(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), f"{name}-ways")
    labels = staged(ways.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), name)
    while True:
        near = ways.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = staged(low.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), name)
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def candidates(sets: DataFrame, bands: Bands, delete_upto: int) -> DataFrame:
    """``list``, ``node``, ``band``, ``spare``, ``score``; ``list`` is null in a row for a set whose segments don't suffice."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists, columns = [], []
            for x, t, score in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = np.frombuffer(t, "<u8")
                for band in (bands.of(len(h)), bands.of(len(h)) + 1):
                    if band > bands.of(len(h)) and len(h) * 100 // bands.percent < bands.low[band]:
                        continue  # no partner is so large
                    s, spare, enough = signatures(h, bands, band, delete_upto)
                    lists += [pa.array(s.view(np.int64))] + [pa.nulls(1, pa.int64())] * (not enough)
                    spare = np.concatenate([spare, np.full(int(not enough), -1)])
                    columns.append(np.stack([np.full(len(spare), v) for v in (x, band)] + [spare, np.full(len(spare), score)]))
            if columns:
                node, band, spare, score = np.concatenate(columns, axis=1)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(lists), pa.array(node), *(pa.array(v.astype(np.int32)) for v in (band, spare, score))], ["list", "node", "band", "spare", "score"])

    return sets.select("node", "tokens", "score").mapInArrow(rows, "list long, node long, band int, spare int, score int")


def allocated(made: DataFrame) -> DataFrame:
    """``list``, ``node``, ``probe``, ``score`` of lists that two sets share: a set spares its longest lists as probes."""
    lists = made.filter("list IS NOT NULL")
    # Staged, so that the shuffles behind it go before those of the windows and groups come.
    shared = staged(lists.join(lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "list"), "jaccard-shared")
    own = Window.partitionBy("node", "band", F.col("spare") >= 0).orderBy(F.desc("size"), "list")
    ranked = shared.withColumn("probe", (F.col("spare") >= 0) & (F.row_number().over(own) > F.col("spare")))
    members = ranked.groupBy("list", "node").agg(F.max("probe").alias("probe"), F.max("score").alias("score"))
    probed = ranked.filter("probe").select("list").distinct()
    return members.join(probed, "list", "left_semi")


def by_single_shingles(sets: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs of the sets ``short`` (``node``) with every set that shares a shingle."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            h = [np.frombuffer(t, "<i8") for t in b.column(1).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(h)), [len(x) for x in h]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate(h))], ["node", "shingle"])

    single = lambda d: d.select("node", "tokens").mapInArrow(each, "node long, shingle long")
    mine = single(sets.join(short.select("node").distinct(), "node", "left_semi")).select(F.col("node").alias("x"), "shingle")
    return single(sets).join(mine, "shingle").filter("x <> node").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``node``, ``label`` with the components that the new links join."""
    ends = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    return staged(labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "jaccard-labels")


def linked_components(sets: DataFrame, percent: int, rounds: int = 1, delete_upto: int = DELETIONS_UPTO) -> DataFrame:
    """``node``, ``label``: the components of all links between ``sets`` (``node``, ``n``, ``tokens``, ``score``).

    In a turn each list's member of the highest score is the pivot and is held against the members of other
    components. The list goes on without its pivot while its members are of several components; after
    ``rounds`` turns the sets that are left meet by their rarest shingles, their pairs are bounded in blocks, and those
    within the bound are verified.
    """
    made = staged(candidates(sets, Bands(percent), delete_upto), "jaccard-lists")
    labels, tested = sets.select("node", F.col("node").alias("label")), None

    def test(pairs: DataFrame) -> None:
        nonlocal labels, tested
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = staged(verify(pairs, sets, percent), "jaccard-links")
        if found.limit(1).count():
            labels = relabelled(labels, found)

    short = made.filter("list IS NULL").select("node").distinct()
    if short.limit(1).count():
        test(by_single_shingles(sets, short).select(F.col("a").alias("x"), F.col("b").alias("y")))
    members = staged(allocated(made), "jaccard-members")
    for _ in range(rounds):
        now = members.join(labels, "node")
        top = now.groupBy("list").agg(F.max(F.struct("score", "node", "label")).alias("p"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("probe").alias("any")).filter("l0 <> l1 AND any")
        others = staged(now.join(top.select("list", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label")), "list").filter("node <> pivot"), "jaccard-others")
        if not others.limit(1).count():
            return labels
        test(others.filter("label <> pivot_label").select(F.col("node").alias("x"), F.col("pivot").alias("y")))
        members = others.select("list", "node", "probe", "score")
    now = members.join(labels, "node")
    mixed = now.groupBy("list").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("probe").alias("any")).filter("l0 <> l1 AND any").select("list")
    left = staged(now.join(mixed, "list").select("node", "label").distinct(), "jaccard-left")
    if left.limit(1).count():
        test(close_pairs(rare_groups(left, sets, percent), sets, percent))
    return labels


def rare_groups(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups in which any two linked sets of ``left`` (``node``, ``label``) of different labels meet: ``list`` (the member
    that shares most), ``node``, ``label``, ``main`` (whether that is the group's largest component), ``mains`` and ``rest``
    (the group's members in that component and out of it).

    A set of ``n`` shares at least ``percent`` per cent of ``n`` with a partner, all of it in shingles of several labels. In an
    order of these by rarity, partners' first common one is among the first of each, those before the last that it can't miss.
    """

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            h = [np.frombuffer(t, "<i8") for t in b.column(2).to_pylist()]
            if h:
                of = pa.array(np.repeat(np.arange(len(h)), [len(x) for x in h]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(h))], ["node", "label", "shingle"])

    single = sets.join(left, "node").select("node", "label", "tokens").mapInArrow(each, "node long, label long, shingle long")
    common = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("shingle", "holders")
    own = Window.partitionBy("node")
    ranked = single.join(common, "shingle").withColumns({"at": F.row_number().over(own.orderBy("holders", "shingle")), "shared": F.count(F.lit(1)).over(own)})
    first = ranked.join(sets.select("node", "n", "score"), "node").filter(f"at <= shared - (n * {percent} + 99) div 100 + 1")
    met = staged(first.select("shingle", "node", "label", "score"), "jaccard-rare")
    top = met.groupBy("shingle").agg(F.max(F.struct("score", "node")).alias("top"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("shingle", F.col("top.node").alias("list"))
    groups = staged(met.join(top, "shingle").select("list", "node", "label").distinct(), "jaccard-groups")
    by_label = groups.groupBy("list", "label").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_label.groupBy("list").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("size")).select("list", F.col("most.label").alias("of"), F.col("most.k").alias("mains"), (F.col("size") - F.col("most.k")).alias("rest"))
    return groups.join(sizes, "list").select("list", "node", "label", (F.col("label") == F.col("of")).alias("main"), "mains", "rest")


#: Members of a group that are held against each other in one place.
BLOCK = 128


def in_blocks(groups: DataFrame) -> DataFrame:
    """``list``, ``node``, ``label``, ``block`` and each two blocks ``lo``, ``hi`` of the group in which a row meets others.

    Blocks of the largest component come last and meet only those of the others, so a member of it has a row for each
    block of theirs.
    """
    mains, rest = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("mains", "rest"))
    hashed = F.xxhash64("node", "list")
    one = groups.withColumn("block", F.when(F.col("main"), rest + F.pmod(hashed, mains)).otherwise(F.pmod(hashed, rest)))
    met = one.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), rest).otherwise(rest + mains) - 1)))
    return met.select("list", "node", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def close_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x``, ``y`` of different labels in a group (see ``rare_groups``) that may link.

    Each two blocks of a group meet with 16 bits of each shingle: common ones there, and shingles of a set that
    have the same 16 bits, bound the intersection from above. Only pairs whose bound reaches the limit leave the
    task.
    """

    def short(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            cut = [np.unique((np.frombuffer(t, "<u8") >> np.uint64(17)).astype(np.uint16)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.binary())], ["node", "n", "cut"])

    def bound(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("list", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        key = np.stack([t[c].to_numpy() for c in ("list", "lo", "hi")])
        edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        node, label, block, n = (t[c].to_numpy() for c in ("node", "label", "block", "n"))
        cuts, out = t["cut"].to_pylist(), [np.zeros((0, 2), np.int64)]
        for i, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            values = [np.frombuffer(c, np.uint16) for c in cuts[i:e]]
            held = np.array([len(v) for v in values])
            column = np.unique(np.concatenate(values), return_inverse=True)[1]
            grid = np.zeros((e - i, column.max() + 1), np.float32)
            grid[np.repeat(np.arange(e - i), held), column] = 1
            first, second = np.flatnonzero(block[i:e] == key[1, i]), np.flatnonzero(block[i:e] == key[2, i])
            common = grid[first] @ grid[second].T
            size, twins = n[i:e], n[i:e] - held
            most = common + np.minimum(twins[first][:, None], twins[second][None, :])
            close = (100 + percent) * most >= percent * (size[first][:, None] + size[second][None, :])
            close &= label[i:e][first][:, None] != label[i:e][second][None, :]
            a, b = np.nonzero(close)
            out.append(np.stack([node[i:e][first[a]], node[i:e][second[b]]], axis=1))
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    places = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    met = in_blocks(groups)
    needed = sets.join(groups.select("node").distinct(), "node", "left_semi")
    cut = needed.select("node", "n", "tokens").mapInArrow(short, "node long, n int, cut binary")
    sent = met.join(cut, "node").withColumn("place", F.pmod(F.xxhash64("list", "lo", "hi"), F.lit(places)))
    return sent.groupBy("place").applyInArrow(bound, "x long, y long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, **how) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``key`` (a hash of the text), ``n_shingles``, ``component_id``, ``first``
    (whether the row is the one that stands for its component, the least by id, null ids last, then key; rows alike in id and text
    are one)."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.col(id_col)).alias("key"), F.col(text_col).alias("text"))
    rows = staged(sets_and_shares(named, k, percent), "jaccard-sets")
    reps = rows.filter("may").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("r"), F.max("score").alias("score")).select(F.col("r.key").alias("node"), "score")
    reps = staged(reps, "jaccard-reps")

    def tokens(batches):
        import numpy as np
        import pyarrow as pa

        for b in by_bytes(batches, 1):
            h, n = shingle_sets(b.column(1), k)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int32)), pa.array([h[e - s : e].tobytes() for e, s in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["node", "score", "n", "tokens"])

    # Rows alike in id and text give the same set; one is kept.
    # Texts are shuffled at any size: the few that are left of a small table would be broadcast, those of a large one couldn't.
    texts = named.select(F.col("key").alias("node"), "text").join(reps.hint("merge"), "node").select("node", "text", "score")
    sets = staged(texts.mapInArrow(tokens, "node long, score int, n int, tokens binary").groupBy("node").agg(F.max("score").alias("score"), F.max("n").alias("n"), F.first("tokens").alias("tokens")), "jaccard-tokens")
    label = linked_components(sets, percent, **how)
    # From classes to documents: a class has the label of its representative, or stands alone.
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("r")).select("digest", "least", "r", F.col("r.key").alias("node"))
    labelled = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named_by = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.min("r").alias("least_row"))
    by_class = labelled.join(named_by, "label").select("digest", "component_id", F.col("least_row.id").alias("r_id"), F.col("least_row.key").alias("r_key"))
    out = rows.join(by_class, "digest", "left")
    return out.select("id", "key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key"))).otherwise(True).alias("first"))


def op9_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
