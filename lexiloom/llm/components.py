"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the minima are written first: then both sides of the join are plain exchanges that AQE may split
    m = cut(_minima(both), "cc-min")
    out = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(out.distinct(), "cc-large"), m


def _small(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    m = cut(_minima(down), "cc-min")
    out = down.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(out.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "cc-small"), m


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): for every id of an edge the smallest id reachable from it.

    Ids may be of any ordered type. Null ends and self-loops are ignored; repeated edges count once; no
    edges give an empty table. Each step is a written table, so memory and lineage stay bounded, and the
    number of steps grows with the logarithm of a component's diameter. Nothing but one number of each
    step reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e, seen = cut(e, "cc-edges"), None
    for _ in range(rounds):
        large, m1 = _large(e)
        small, m2 = _small(large)
        for x in (e, large, m1, m2):
            discard(x)
        e = small
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
