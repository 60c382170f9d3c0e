"""One report for every predictor: overall error, error by rating, confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import dead_zone, whole


def overall(df: DataFrame, truth: str = "rating", prediction: str = "prediction") -> DataFrame:
    """One row: mse with the dead zone of half a star, and the number of rows."""
    return df.agg(F.avg(dead_zone(F.col(prediction) - F.col(truth))).alias("mse"), F.count(F.lit(1)).alias("n"))


def per_score(df: DataFrame, truth: str = "rating", prediction: str = "prediction") -> DataFrame:
    """score, mse (no dead zone) and n for every rating that occurs."""
    error = F.col(prediction) - F.col(truth)
    return df.groupBy(F.col(truth).alias("score")).agg(F.avg(error * error).alias("mse"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str = "rating", prediction: str = "prediction") -> DataFrame:
    """truth, predicted, n, percent of the row, for every pair of ratings that occur; rounded predictions that are
    no rating of the data have a column too. The grid is square in the number of ratings only."""
    cells = df.groupBy(F.col(truth).cast("int").alias("truth"), whole(F.col(prediction)).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    listed = cells.agg(F.collect_list(F.struct("truth", "predicted", "n")).alias("cells"))  # few: the predictions are read once
    truths, said = F.transform("cells", lambda x: x["truth"]), F.transform("cells", lambda x: x["predicted"])
    grid = listed.select("cells", F.explode(F.array_distinct(truths)).alias("truth"))
    grid = grid.select("cells", "truth", F.explode(F.array_distinct(F.concat(truths, said))).alias("predicted"))
    own = F.filter("cells", lambda x: (x["truth"] == F.col("truth")) & (x["predicted"] == F.col("predicted")))
    grid = grid.select("truth", "predicted", F.coalesce(F.get(own, F.lit(0))["n"], F.lit(0)).alias("n"))
    return grid.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("truth")))


def make_analysis(df: DataFrame, truth: str = "rating", prediction: str = "prediction") -> tuple[DataFrame, DataFrame, DataFrame]:
    return overall(df, truth, prediction), per_score(df, truth, prediction), confusion(df, truth, prediction)


def report(df: DataFrame, domain: str = "all", truth: str = "rating", prediction: str = "prediction") -> DataFrame:
    """make_analysis() as one table: domain, part, truth, predicted, value, n. The value of the parts `overall` (one
    row) and `score` (one for each rating) is the error, that of `confusion` the percent of the rating's row."""
    total, by, cells = make_analysis(df, truth, prediction)
    none = F.lit(None).cast("int")
    rows = total.where("n > 0").select(F.lit("overall").alias("part"), none.alias("truth"), none.alias("predicted"), F.col("mse").alias("value"), "n")
    rows = rows.unionAll(by.select(F.lit("score"), F.col("score").cast("int"), none, "mse", "n"))
    rows = rows.unionAll(cells.select(F.lit("confusion"), "truth", "predicted", "percent", "n"))
    return rows.select(F.lit(domain).alias("domain"), "*")
