"""Sharding by a minimax contiguous partition of ordered atomic groups (native).

Rows stand in one global order: by the digest of their text, so that equal texts (a group, which no cut may
divide) are neighbours. The smallest capacity with which a greedy walk needs no more than the given number
of shards is found by binary search; the shards are cut there.

The driver never sees the groups. It holds a sketch of their prefix sums: some exact ones, and how many groups
lie between two of them. Each search runs on the sketch twice, once with every unknown cut as early and once
as late as it can be; where the two answers differ, one query over the staged prefix sums refines the
intervals in question into a fixed number of cells, until the answers meet. Rounds grow with the logarithm
of the data, and the sketch with the number of rounds.

Defined results: a null text has no bytes, the crc32 of no bytes, and stands with the empty text; repeated rows are
separate rows of one group; with fewer groups than shards some shards are empty; an empty table gives no rows.
Columns of ``docs`` are carried along; names the operator adds start with ``s_``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden, hidden_name, in_global_order, shown, staged, table


#: Intervals that one query refines; the first ones decide where the later cuts can be.
AT_ONCE = 256


class Sketch:
    """Exact prefix sums ``at`` (0 first, the total last); ``groups[i]`` groups end in ``(at[i-1], at[i]]``."""

    def __init__(self, total: int, groups: int):
        self.at, self.groups = [0, total], [0, groups]

    def floor(self, x: int, late: bool = False) -> int:
        """The last group's end not behind ``x``: known if nothing unknown lies between, else its least or
        (``late``) greatest possible value."""
        i = bisect_right(self.at, x) - 1
        if i == len(self.at) - 1 or self.groups[i + 1] <= 1:
            return self.at[i]
        return min(x, self.at[i + 1] - 1) if late else self.at[i]

    def unknown(self, lo: int, hi: int) -> list[int]:
        """Numbers of the intervals between ``lo`` and ``hi`` that hold ends not known yet."""
        return [i for i in range(max(1, bisect_left(self.at, lo)), min(bisect_right(self.at, hi) + 1, len(self.at))) if self.groups[i] > 1]

    def refine(self, ends: DataFrame, which: list[int], cells: int) -> None:
        """One query: each of the intervals (of the first ``AT_ONCE``) is cut into equal cells, two or more; a cell gives its
        first and last end and its groups, so an interval always comes out with fewer unknown ends.

        A row finds its interval by halving, so neither its cost nor the depth of the expression grows with their number.
        """
        which = which[:AT_ONCE]
        each = max(2, cells // len(which))
        lo, hi = [self.at[i - 1] for i in which], [self.at[i] for i in which]

        def place(a: int, b: int) -> str:
            m = (a + b) // 2
            return str(a) if b - a == 1 else f"IF(end <= {hi[m - 1]}L, {place(a, m)}, {place(m, b)})"

        bound = lambda xs: f"element_at(array({', '.join(f'{x}L' for x in xs)}), interval + 1)"
        here = ends.selectExpr("end", f"{place(0, len(which))} AS interval").selectExpr("end", "interval", f"{bound(lo)} AS lo", f"{bound(hi)} AS hi").where("end > lo AND end <= hi")
        found = here.groupBy("interval", F.expr(f"((end - lo - 1) * {each}) DIV (hi - lo)").alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        got = {}
        for r in found.collect():  # at most `cells` rows, or two for each interval
            got[r["end"]] = r["n"] - 1
            got[r["first"]] = 1
        known = dict(zip(self.at, self.groups, strict=True))
        for i in which:
            known.pop(self.at[i])
        self.at, self.groups = map(list, zip(*sorted((known | got).items()), strict=True))


def search(sketch: Sketch, ends: DataFrame, shards: int, largest: int, cells: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the greedy cuts at it."""
    total = sketch.at[-1]

    def walk(capacity: int, late: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = sketch.floor(at + capacity, late)
            cuts.append(at)
            if at >= total:
                break
        return cuts

    def least(late: bool, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if walk(mid, late)[-1] >= total else (mid + 1, hi)
        return lo

    lo, hi = max(largest, -(-total // shards)), total
    while True:
        lo, hi = least(True, lo, hi), least(False, lo, hi)
        if lo == hi:
            return lo, walk(lo, False)
        early, late = walk(lo, False), walk(hi, True)
        early += [early[-1]] * (len(late) - len(early))
        which = sorted({i for a, b in zip(early, late, strict=False) for i in sketch.unknown(a, min(b, total))})
        sketch.refine(ends, which, cells)


def balanced(sketch: Sketch, ends: DataFrame, shards: int, capacity: int, cells: int) -> list[int]:
    """Cuts with no shard over ``capacity``, each as near as it can be to an equal share of what is left.

    The greedy walk fills the first shards and may leave the last ones empty where one large group sets the
    capacity. Lookups that the sketch can't answer are refined together, and the walk is done again.
    """
    total = sketch.at[-1]
    while True:
        missed: set[int] = set()

        def floor(x: int) -> int:
            if x < total:
                i = bisect_right(sketch.at, x)
                if sketch.groups[i] > 1:
                    missed.add(i)
            return sketch.floor(min(x, total))

        def ceil(x: int) -> int:
            if x <= 0:
                return 0
            i = bisect_left(sketch.at, x)
            if sketch.groups[i] > 1:
                missed.add(i)
            return sketch.at[i]

        need = [total]  # from the back: the earliest cut behind which the rest still fits
        for _ in range(shards - 1):
            need.append(ceil(need[-1] - capacity))
        need.reverse()
        cuts, at = [], 0
        for j in range(shards):
            goal = at + -(-(total - at) // (shards - j))
            below, above = floor(goal), ceil(goal) if goal < total else total
            near = above if above - goal < goal - below and above - at <= capacity else below
            at = min(max(near, need[j], at), floor(at + capacity))
            cuts.append(at)
        if not missed:
            return cuts
        sketch.refine(ends, sorted(missed), cells)


def shard(docs: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id", row_bytes: int = 16, cells: int = 4096, parts: int | None = None) -> DataFrame:
    """``docs`` without the text, and with ``s_size``, ``s_crc32``, ``s_shard`` and ``s_slot`` (gapless in the shard).

    ``row_bytes``: added to a row's bytes. ``cells``: rows of prefix sums that the driver asks for in a round.
    """
    spark = docs.sparkSession
    rows, text = hidden(docs), hidden_name(docs, text_col)
    bytes_of: Column = F.coalesce(F.col(text), F.lit(""))
    rows = rows.select(
        *[c for c in rows.columns if c != text],
        (F.octet_length(bytes_of) + row_bytes).cast("long").alias("s_size"),
        F.crc32(bytes_of).alias("s_crc32"),
        F.unhex(F.sha2(bytes_of, 256)).alias("s_digest"),
        F.col(hidden_name(docs, id_col)).alias("s_id"),
        F.monotonically_increasing_id().alias("s_row"),
    )
    carried = [c for c in rows.columns if c.startswith("__")]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(in_global_order(rows, ["s_digest", "s_id", "s_row"], parts, {"s_end": "s_size"}, "shard-order"), "shard-placed")
    ends = staged(placed.groupBy("s_digest").agg(F.max("s_end").alias("end"), F.sum("s_size").alias("size")).select("end", "size"), "shard-ends")
    whole = ends.agg(F.max("end").alias("total"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).first()
    cuts = [0]
    if whole["n"]:
        sketch = Sketch(whole["total"], whole["n"])
        capacity, _ = search(sketch, ends, shards, whole["largest"], cells)
        cuts = balanced(sketch, ends, shards, capacity, cells)
    number = sum((F.when(F.col("s_end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    out = placed.withColumn("s_shard", number.cast("int"))
    first = out.groupBy("s_shard").agg(F.min("pos").alias("s_first"))  # one row for each shard
    out = out.join(F.broadcast(first), "s_shard").select(*carried, "s_size", "s_crc32", "s_shard", (F.col("pos") - F.col("s_first")).alias("s_slot"))
    return shown(out, docs, but=(next(c for c in docs.columns if c.lower() == text_col.lower()),))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.select("doc_id", F.col("s_size").alias("size"), F.col("s_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("s_shard").alias("shard"), F.col("s_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
