"""Minimax contiguous partition: cut an ordered sequence of atomic groups into k runs whose largest
byte total is the smallest possible.

Groups are documents of equal text, ordered by the SHA-256 of the text; a group is never divided. The
smallest feasible capacity is found by binary search, each probe checked greedily. The group ends of the
whole corpus never reach the driver: it holds, for every probed stretch, only the first and last end in
each of BUCKETS equal slices, which bounds each greedy step from both sides, and asks for a finer slicing
of just those stretches in which the bounds still differ.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, prefix_sums, table

BUCKETS = 4096
SHARDS = 8


def _ends(groups: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) group end of every non-empty slice of every span (lo, hi]; one pass."""
    end = F.col("end")
    which = F.lit(None).cast("long")
    for i, (lo, hi) in enumerate(spans):
        step = max(1, -(-(hi - lo) // BUCKETS))
        slot = F.floor((end - F.lit(lo + 1)) / F.lit(step)) + F.lit(i * 2 * BUCKETS)
        which = F.when((end > lo) & (end <= hi), slot).otherwise(which)
    rows = groups.select(end, which.alias("slot")).where("slot is not null")
    return [(r[1], r[2]) for r in rows.groupBy("slot").agg(F.min("end"), F.max("end")).collect()]


def _greedy(points: list[int], gaps: set[int], total: int, cap: int, k: int, high: bool) -> list[int] | None:
    """Greedy cuts under `cap`, taking for each the largest known end (low bound), or where ends may be
    unknown the largest conceivable one (high bound). None if k runs don't reach the total."""
    at, cuts = 0, []
    for _ in range(k):
        reach = at + cap
        if reach >= total:
            return cuts
        i = bisect.bisect_right(points, reach) - 1
        best = points[i] if i >= 0 else 0
        if high and best in gaps:  # between this end and the next known one there are others
            best = reach
        if best <= at:
            return None
        at = best
        cuts.append(at)
    return None


def minimax_cuts(groups: DataFrame, k: int, start: str = "begin") -> tuple[int, list[int]]:
    """(capacity, cuts) for groups with long columns `end` (running total) and `size` > 0.

    Empty input gives (0, []). The capacity is exact: the least for which k contiguous runs suffice."""
    total, largest = groups.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, []
    spans, known, gaps = [(0, total)], {0}, set()
    lo_cap = max(largest, -(-total // k))
    hi_cap = total
    while True:
        gaps = {g for g in gaps if not any(lo <= g < hi for lo, hi in spans)}
        for first, last in _ends(groups, spans):
            known |= {first, last}
            if last > first:
                gaps.add(first)
        points = sorted(known)

        def least(high: bool, lo: int, hi: int) -> int:
            while lo < hi:
                mid = (lo + hi) // 2
                if _greedy(points, gaps, total, mid, k, high) is not None:
                    hi = mid
                else:
                    lo = mid + 1
            return lo

        lo_cap, hi_cap = least(True, lo_cap, hi_cap), least(False, lo_cap, hi_cap)
        low = _greedy(points, gaps, total, lo_cap, k, False) if lo_cap == hi_cap else None
        open_spans = set()
        at_lo = at_hi = 0
        for _ in range(k):  # where may each cut lie: from the low bound at lo_cap to the high one at hi_cap
            at_lo, at_hi = min(at_lo + lo_cap, total), min(at_hi + hi_cap, total)
            i = bisect.bisect_right(points, at_lo) - 1
            at_lo = points[i]
            j = bisect.bisect_right(points, at_hi) - 1
            top = at_hi if points[j] in gaps else points[j]
            unsure = [g for g in range(i, j + 1) if points[g] in gaps]
            if unsure:  # one span for each cut, so that the slicing stays a short expression
                open_spans.add((points[unsure[0]], points[unsure[-1] + 1]))
            at_hi = top
        if not open_spans or low is not None and low == _greedy(points, gaps, total, lo_cap, k, True):
            return hi_cap, _greedy(points, gaps, total, hi_cap, k, False) or []
        spans = _merge(sorted(open_spans))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard and its place there: id_col, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1. A null text has no bytes, crc32 0, and shares a group only with
    other nulls, not with the empty text. Null ids sort first; repeated rows each get a slot of their own.
    An empty table gives an empty result. Fewer groups than shards leave the last shards empty.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("grp"),
    )
    order = ["grp", "id"]
    placed = cut(prefix_sums(rows, order, {"upto": F.col("size"), "nth": F.lit(1).cast("long")}, "shard-rows"), "shard-sums")
    groups = cut(
        placed.groupBy("grp").agg(F.max("upto").alias("end"), F.sum("size").alias("size")).select("end", "size"), "shard-groups"
    )
    _, cuts = minimax_cuts(groups, shards)
    discard(groups)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("upto") > F.lit(c)).cast("int")
    first = {r[0]: r[1] for r in placed.groupBy(shard.alias("s")).agg(F.min("nth")).collect()}
    base = F.lit(0).cast("long")
    for s, n in first.items():
        base = F.when(shard == s, F.lit(n).cast("long")).otherwise(base)
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), shard.alias("shard"), (F.col("nth") - base).alias("slot")
    )


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
