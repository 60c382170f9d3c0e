"""Descriptive tables: words by rating, cloud scales and layout, lengths."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import PALETTE, stars, valid
from ..functions.text import alpha_words, first_place, spaced

# Words of a spiral cloud, font sizes, step of the angle and of the radius, largest radius.
SPIRAL_WORDS, SMALL, LARGE, TURN, GROWTH, FURTHEST = 60, 8.0, 45.0, 0.15, 0.8 * 0.05, 400.0


def frequencies(reviews: DataFrame, tokens: Column, groups: list[str], top: int | None = None) -> DataFrame:
    """groups, word, cnt, rank: words by number of occurrences, the one seen first on ties; the `top` of each group."""
    seen = reviews.select(*groups, "review_id", F.posexplode(tokens).alias("place", "word"))
    counts = seen.groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("cnt"), first_place().alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("cnt"), "_first"))
    out = counts.withColumn("rank", rank).drop("_first")
    return out if top is None else out.where(F.col("rank") <= top)


def by_stars(reviews: DataFrame) -> DataFrame:
    return reviews.where(valid(F.col("rating"))).withColumn("stars", stars(F.col("rating")))


def polarity(reviews: DataFrame) -> DataFrame:
    """Only ratings 1 and 5, as negative and positive."""
    return reviews.where(F.col("rating").isin(1.0, 5.0)).withColumn("polarity", F.when(F.col("rating") == 1.0, "negative").otherwise("positive"))


def word_totals(reviews: DataFrame) -> DataFrame:
    """stars, n_words, n_unique, colour of its cloud."""
    counts = frequencies(by_stars(reviews), alpha_words(F.col("text")), ["stars"])
    totals = counts.groupBy("stars").agg(F.sum("cnt").alias("n_words"), F.count(F.lit(1)).alias("n_unique"))
    palette = F.create_map(*[F.lit(x) for k, (r, g, b) in PALETTE.items() for x in (k, f"rgb({r},{g},{b})")])
    return totals.withColumn("colour", palette[F.col("stars")])


def cloud_scale(top: DataFrame, groups: list[str]) -> DataFrame:
    """Words of frequencies(..., top) with color_idx (1 down to 0.4 by rank) and fontsize (8 to 45 by count)."""
    w = Window.partitionBy(*groups)
    lo, hi, n = F.min("cnt").over(w), F.max("cnt").over(w), F.count(F.lit(1)).over(w)
    size = F.when(hi == lo, F.lit(LARGE)).otherwise(SMALL + (F.col("cnt") - lo) * (LARGE - SMALL) / (hi - lo))
    return top.withColumn("fontsize", size).withColumn("color_idx", 1.0 - (F.col("rank") - 1) / n * 0.6)


def cloud_layout(scaled: DataFrame, group: str) -> DataFrame:
    """x, y, w, h of each word's box: along a spiral to the first place where it meets no earlier box (boxes that
    touch do meet). A word without a place within the largest radius has no row. A group has SPIRAL_WORDS rows at
    most, since `scaled` is a top list."""
    turn, growth, furthest = TURN, GROWTH, FURTHEST

    def lay(words: pd.DataFrame) -> pd.DataFrame:
        placed: list[tuple[float, float, float, float]] = []
        rows = []
        for word in words.sort_values("rank").itertuples():
            w, h = len(word.word) * word.fontsize * 0.5, word.fontsize
            for step in range(int(furthest / growth) + 1):
                x, y = step * growth * math.cos(step * turn), step * growth * math.sin(step * turn)
                if all(abs(x - px) * 2 > w + pw or abs(y - py) * 2 > h + ph for px, py, pw, ph in placed):
                    placed.append((x, y, w, h))
                    rows.append((getattr(word, group), word.rank, word.word, word.cnt, x, y, w, h, word.fontsize, word.color_idx))
                    break
        return pd.DataFrame(rows, columns=[group, "rank", "word", "cnt", "x", "y", "w", "h", "fontsize", "color_idx"])

    kind = scaled.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, rank int, word string, cnt bigint, x double, y double, w double, h double, fontsize double, color_idx double"
    return scaled.select(group, "rank", "word", "cnt", "fontsize", "color_idx").groupBy(group).applyInPandas(lay, schema)


def lengths(reviews: DataFrame) -> DataFrame:
    """review_id, stars, n_words by white space."""
    return by_stars(reviews).select("review_id", "stars", F.size(spaced(F.col("text"))).alias("n_words"))


def length_boxes(reviews: DataFrame) -> DataFrame:
    """stars, n, quartiles (interpolated), and whiskers: the furthest length within 1.5 times their distance.

    Lengths are counted first, so that what is sorted grows with the number of different lengths."""
    counts = lengths(reviews).groupBy("stars", "n_words").agg(F.count(F.lit(1)).alias("c"))
    q = F.percentile(F.col("n_words").cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
    own = Window.partitionBy("stars")
    boxes = counts.withColumns({"n": F.sum("c").over(own), "_q": q.over(own)})
    boxes = boxes.select("stars", "n", "n_words", *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)])
    far = 1.5 * (F.col("q3") - F.col("q1"))
    inside = boxes.where(F.col("n_words").between(F.col("q1") - far, F.col("q3") + far))
    return inside.groupBy("stars", "n", "q1", "q2", "q3").agg(F.min("n_words").alias("whisker_lo"), F.max("n_words").alias("whisker_hi"))
