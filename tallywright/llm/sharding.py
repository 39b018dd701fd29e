"""Minimax contiguous partition of atomic groups into shards, by DataFrame operations alone.

Rows with equal text form one atomic group. Groups are ordered by the SHA-256 of their text, which
spreads copies and sources evenly; a shard is a contiguous run of groups. The smallest capacity that
any cut into ``shards`` runs can reach is found by binary search with a greedy check.

The check needs only "the last group that ends at or before byte t". The driver holds a bounded set
of known group ends (at most ``points`` per refinement) and knows between which of them nothing else
lies. A search over that set brackets the capacity from both sides; the few gaps that the remaining
cuts can fall into are then summarised again from the distributed prefix sums, until the bracket is
closed. Every refinement divides a gap by the number of points, so 100 TB take about five.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .tables import free

#: Group keys start with so many hex digits of their block: 65,536 blocks for prefix sums.
BLOCK_DIGITS = 4


class GroupEnds:
    """Prefix sums of ordered groups: exact answers from a bounded summary on the driver."""

    def __init__(self, ends: DataFrame, total: int, points: int):
        self.ends, self.total, self.points = ends, total, points
        self.known = [0, total]
        #: tight[i]: no group ends between known[i] and known[i + 1]
        self.tight = [False]
        #: rows are joined to gaps by cell: a gap is a part of an earlier one, so it meets one or two
        self.cell = -(-total // points)
        self.refine({(0, total)})

    def refine(self, gaps: set[tuple[int, int]]) -> None:
        """Learn up to two ends in each of ``points`` equal parts of these gaps between known ends."""
        gaps = {(a, b) for a, b in gaps if b - a > 1}
        if not gaps:
            return
        per = max(2, self.points // len(gaps))
        rows = self.ends
        if gaps == {(0, self.total)}:
            rows = rows.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(self.total).cast("long")})
        else:
            values = ", ".join(f"({c}L, {a}L, {b}L)" for a, b in sorted(gaps) for c in range(a // self.cell, b // self.cell + 1))
            table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS gaps(cell, a, b)")
            rows = rows.withColumn("cell", F.expr(f"end div {self.cell}L")).join(table, "cell")
        part = F.expr(f"CAST((end - a) * {per}D / (b - a) AS LONG)")
        found = (
            rows.filter("end > a AND end < b")
            .groupBy("a", part.alias("part"))
            .agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count_distinct("end").alias("n"))
            .collect()
        )
        known = dict.fromkeys(self.known)
        loose = {k for k, t in zip(self.known, self.tight, strict=False) if not t} - {a for a, _ in gaps}
        for r in found:
            known[r.low] = known[r.high] = None
            if r.n > 2:
                loose.add(r.low)
        self.known = sorted(known)
        self.tight = [k not in loose for k in self.known[:-1]]

    def bounds(self, t: int) -> tuple[int, int]:
        """The last end at or before t lies in this range."""
        i = bisect_right(self.known, t) - 1
        low = self.known[i]
        if low == t or i == len(self.known) - 1 or self.tight[i]:
            return low, low
        return low, min(t, self.known[i + 1] - 1)

    def gap(self, t: int) -> tuple[int, int]:
        i = min(bisect_right(self.known, t) - 1, len(self.known) - 2)
        return self.known[i], self.known[i + 1]

    def last(self, t: int) -> int:
        """The last end at or before t, exactly."""
        while (b := self.bounds(t))[0] != b[1]:
            self.refine({self.gap(t)})
        return b[0]

    def next(self, t: int) -> int:
        """The first end at or after t, exactly."""
        while True:
            i = bisect_left(self.known, t)
            if i == 0 or self.known[i] == t or self.tight[i - 1]:
                return self.known[i]
            self.refine({(self.known[i - 1], self.known[i])})

    def reaches(self, capacity: int, shards: int, side: int) -> bool:
        """Greedy check; side 0 takes each cut as early as it can lie, side 1 as late."""
        at = 0
        for _ in range(shards):
            at = self.bounds(at + capacity)[side]
            if at >= self.total:
                return True
        return False

    def smallest(self, shards: int, side: int) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.reaches(mid, shards, side) else (mid + 1, high)
        return low

    def unsure(self, capacity: int, shards: int) -> set[tuple[int, int]]:
        """Gaps that the greedy check's cuts may fall into."""
        out, low, high = set(), 0, 0
        for _ in range(shards):
            for t in (low + capacity, high + capacity):
                if self.bounds(t)[0] != self.bounds(t)[1]:
                    out.add(self.gap(t))
            low, high = self.bounds(low + capacity)[0], self.bounds(high + capacity)[1]
        return out

    def capacity(self, shards: int, probes: int = 8) -> int:
        """The smallest capacity for which the greedy check succeeds."""
        while (least := self.smallest(shards, 1)) < (most := self.smallest(shards, 0)):
            tried = {least + (most - least) * k // (probes - 1) for k in range(probes)}
            self.refine(set().union(*(self.unsure(c, shards) for c in tried)))
        return most

    def cuts(self, shards: int) -> list[int]:
        """Ends of all shards but the last. No shard is above the smallest capacity, and each cut is the one
        nearest below the mean of what is left, or the first that leaves the rest within capacity."""
        if not self.total:
            return []
        capacity = self.capacity(shards)
        latest = [self.total]  # from the right: where the last k shards may start at the earliest
        while len(latest) < shards and latest[-1] > 0:
            latest.append(self.next(max(0, latest[-1] - capacity)))
        out, at = [], 0
        for left in range(shards, 1, -1):
            need = latest[left - 1] if left - 1 < len(latest) else 0
            aim = self.last(min(at + capacity, at + -(-(self.total - at) // left)))
            if aim <= at:
                aim = self.next(at + 1) if at < self.total else at
            at = max(at, min(max(aim, need), self.last(at + capacity)))
            out.append(at)
        return out


def shard_by_bytes(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, points: int = 4096, rows_per_block: int = 100_000, keep_columns: bool = False) -> DataFrame:
    """Shard, slot and size of every row; equal texts share a shard and the largest shard is as small as can be.

    Returns ``id_col``, size (UTF-8 bytes of the text plus ``overhead``), text_crc32, digest, shard, slot; with
    ``keep_columns`` all columns of the rows, and size, shard and slot under names that none of them has.
    A null text has no bytes; null texts form one group, apart from the empty text. Repeated rows are rows of
    one group and get slots of their own. An empty table gives an empty result. Other columns are ignored, whatever
    their names. A text of any length has its place whole. Groups are never split, so a group above the mean size sets the capacity. Fewer groups than shards leave
    shards empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(f"`{text_col}`")
    rows = scratch.write(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("digest"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *([F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")] if keep_columns else []),
        ),
        "rows",
    )
    block = F.substring("digest", 1, BLOCK_DIGITS).alias("block")
    groups = scratch.write(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = groups.groupBy(block).agg(F.sum("bytes").alias("bytes")).select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("block").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    ends = scratch.write(
        groups.withColumn("block", block).join(blocks, "block").select("digest", (F.col("before") + F.sum("bytes").over(within)).alias("end"), "n"),
        "ends",
    )
    total, count = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cuts = GroupEnds(ends, total, points).cuts(shards) if total else []
    inner = sorted(set(cuts))
    at = {r.end: r.digest for r in ends.filter(F.col("end").isin(inner)).select("end", "digest").collect()} if inner else {}
    marks = F.array(*[F.lit(at.get(c, "")) for c in cuts]) if cuts else F.array().cast("array<string>")
    # a row's shard: the number of cuts before its group; cuts at 0 stand for empty shards
    placed = rows.withColumn("shard", F.size(F.filter(marks, lambda m: m < F.col("digest"))))
    parts = max(32, -(-count // (shards * rows_per_block)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.lit(parts)).cast("int"))
    sums = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "digest"))
    slot = F.col("before") + rank - 1
    out = placed.join(offsets, ["shard", "part"])
    if keep_columns:
        added = {"size": F.col("size"), "shard": F.col("shard"), "slot": slot}
        out = out.select("row", *[c.alias(free(name, docs)) for name, c in added.items()]).select(*[F.col("row")[c].alias(c) for c in docs.columns], *[free(name, docs) for name in added])
    else:
        out = out.select(F.col("id").alias(id_col), "size", "text_crc32", "digest", "shard", slot.alias("slot"))
    scratch.drop(groups, ends)
    return out


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the ``bytes`` law."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
