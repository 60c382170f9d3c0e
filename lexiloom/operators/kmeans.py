"""Spherical mini-batch k-means over unit vectors, statistics of its clusters, and votes of near clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, normalise

# Clusters, batch, iterations, seed, clusters that vote, statistics of an empty cluster (mean, std,
# mode), points of the density curve.
CLUSTERS, BATCH, ITERATIONS, SEED, NEAREST = 50, 3072, 100, 42, 15
EMPTY = (3.0, 0.0, 3.0)
POINTS = 100
#: Vectors whose differences to the centres in question are held at a time.
PIECE = 512


def fit(points: DataFrame, k: int = CLUSTERS, batch: int = BATCH, iterations: int = ITERATIONS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", start: np.ndarray | None = None) -> np.ndarray:
    """Unit centres (k x d), fitted on a batch of all rows in each iteration.

    Each iteration draws a batch (all rows if there are fewer), assigns it to the centres as they are, then moves
    each centre towards its points one by one, by one over the number of points it has had so far: its first point
    replaces it. Centres given as `start` are moved on. Fewer than k rows give as many centres.

    A batch is the rows with the smallest hashes of that iteration. One pass over the table finds them all; of its
    rows at most some batch * iterations, whatever their number, reach the driver.
    """
    rows = points.where(F.col(vector).isNotNull()).select(F.xxhash64(key, vector).alias("id"), vector)
    n, need = rows.count(), max(batch, k)
    if not n:
        return np.zeros((0, 0))
    share = min(1.0, (need + 6 * need**0.5 + 20) / n)  # so that a batch is hardly ever short
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    rounds = F.transform(F.sequence(F.lit(0), F.lit(max(0, iterations - 1))), lambda t: F.struct(t.alias("t"), F.xxhash64("id", F.lit(seed), t).alias("h")))
    drawn = rows.withColumn("lots", F.filter(rounds, lambda r: r["h"] <= bound)).where(F.size("lots") > 0).select("id", "lots", normalise(doubles(F.col(vector))).alias("v")).toArrow()
    x = np.stack([np.asarray(v.values) for v in drawn["v"]])
    lists = drawn["lots"].combine_chunks()
    at = pd.DataFrame({"t": lists.flatten().field("t").to_numpy(), "h": lists.flatten().field("h").to_numpy(), "row": np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())})
    at["id"] = drawn["id"].to_numpy()[at["row"]]
    batches = {t: own["row"].to_numpy() for t, own in at.sort_values(["t", "h", "id"]).groupby("t")}
    centres = x[batches[0][:k]].copy() if start is None else start.copy()
    had = np.zeros(len(centres))
    for t in range(iterations):
        mine = x[batches.get(t, np.zeros(0, np.int64))[:batch]]
        owner = (mine @ centres.T).argmax(axis=1)
        for point, c in zip(mine, owner):
            had[c] += 1
            moved = centres[c] + (point - centres[c]) / had[c]
            centres[c] = moved / (np.linalg.norm(moved) + 1e-12)
    return centres


def first_centres(points: DataFrame, k: int = CLUSTERS, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The first k vectors by key as centres."""
    return np.array([r["v"] for r in points.select(key, normalise(doubles(F.col(vector))).alias("v")).orderBy(key).limit(k).collect()])


def nearest(vector: Column, centres: np.ndarray, x: int) -> Column:
    """array<struct<cluster_id, dist>>: the x centres nearest to the unit vector (Euclid; ties: smallest id).
    Distances are rounded to 9 places first. The centres, a parameter's worth of rows, travel with the function."""

    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for s in range(0, len(part), PIECE):
                v = np.stack(part.iloc[s : s + PIECE].to_list())
                square = (v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1)[None, :]
                # the short form finds the centres in question; their distances are then taken term by term
                width = min(len(centres), x + 8)
                at = np.argpartition(square, width - 1, axis=1)[:, :width]
                dist = np.round(np.sqrt(((v[:, None, :] - centres[at]) ** 2).sum(axis=2)), 9)
                out += [[{"cluster_id": int(a[j]), "dist": float(d[j])} for j in np.lexsort((a, d))[:x]] for a, d in zip(at, dist)]
            yield pd.Series(out)

    return F.pandas_udf(near, "array<struct<cluster_id int, dist double>>")(vector)


def assign(points: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """points with cluster_id, the centre of the largest inner product (for unit vectors the nearest one)."""
    unit = points.withColumn("_v", normalise(doubles(F.col(vector)))).where("_v is not null")
    return unit.withColumn("cluster_id", nearest(F.col("_v"), centres, 1)[0]["cluster_id"]).drop("_v")


def cluster_stats(assigned: DataFrame, k: int, label: str = "label") -> DataFrame:
    """cluster_id, n, mean, std (population), mode (smallest label on ties) for each of k clusters."""
    counts = assigned.groupBy("cluster_id", F.col(label).cast("double").alias("l")).agg(F.count(F.lit(1)).alias("c"))
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("l"))
    mode = F.max_by("l", F.struct(F.col("c"), -F.col("l")))
    square = F.sum(F.col("c") * F.col("l") * F.col("l")) / n - (total / n) * (total / n)
    stats = counts.groupBy("cluster_id").agg(n.alias("n"), (total / n).alias("mean"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("std"), mode.alias("mode"))
    scale = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return scale.join(stats, "cluster_id", "left").select(
        "cluster_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(EMPTY[0])).alias("mean"),
        F.coalesce("std", F.lit(EMPTY[1])).alias("std"), F.coalesce("mode", F.lit(EMPTY[2])).alias("mode"),
    )


def predict(queries: DataFrame, centres: np.ndarray, stats: DataFrame, x: int = NEAREST, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """key, rating, prediction: modes of the x nearest clusters, weighted by 1 / (distance + 1e-8)."""
    unit = queries.select(key, F.col(label).cast("double").alias("rating"), normalise(doubles(F.col(vector))).alias("_v")).where("_v is not null")
    near = unit.select(key, "rating", F.explode(nearest(F.col("_v"), centres, x)).alias("near"))
    w = 1.0 / (F.col("near.dist") + 1e-8)
    scores = stats.select(F.col("cluster_id").alias("_c"), F.col("mode").alias("_m"))
    voted = near.join(F.broadcast(scores), F.col("near.cluster_id") == F.col("_c"))
    return voted.groupBy(key, "rating").agg((F.sum(w * F.col("_m")) / F.sum(w)).alias("prediction"))


def spread(stats: DataFrame, points: int = POINTS, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    """cluster_id, mode, x, density: the normal curve of each cluster with a deviation above 0."""
    step = (hi - lo) / (points - 1)
    curve = stats.where("std > 0").select("cluster_id", "mode", "mean", "std", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(lo) + F.col("i") * F.lit(step)
    z = (x - F.col("mean")) / F.col("std")
    return curve.select("cluster_id", "mode", "i", x.alias("x"), (F.exp(-z * z / 2) / (F.col("std") * F.sqrt(2 * F.pi()))).alias("density"))


def as_table(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster_id int, center array<double>")
