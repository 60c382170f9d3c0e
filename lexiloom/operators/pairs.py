"""Training pairs of an encoder: seeded partners, contrastive loss, mean pooling, batched encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import agreement
from ..functions.text import words
from ..functions.vectors import cosine
from ..sources.order import rank_by_hash

# Temperature, guard of the logarithm, width of an embedding, texts of a batch.
TEMPERATURE, GUARD, WIDTH, BATCH = 0.07, 1e-8, 128, 64
SEED = 42


def rating_pairs(reviews: DataFrame, key: str = "review_id", rating: str = "rating", seed: int = SEED) -> DataFrame:
    """left_id, right_id, left_rating, right_rating, similarity: each row with one row drawn by a seeded hash
    (itself, perhaps); similarity is 1 - |difference| / largest rating."""
    ranked = rank_by_hash(reviews.select(key, rating), key, str(seed), "_at")
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":pair:{seed}")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    left = ranked.select(F.col(key).alias("left_id"), F.col(rating).alias("left_rating"), (h % F.col("_at_of") + 1).alias("_want"))
    right = ranked.select(F.col(key).alias("right_id"), F.col(rating).alias("right_rating"), F.col("_at").alias("_want"))
    top = reviews.agg(F.max(rating).alias("_top"))  # one row
    out = left.join(right, "_want").join(F.broadcast(top), F.lit(True))
    return out.select("left_id", "right_id", "left_rating", "right_rating", agreement(F.col("left_rating"), F.col("right_rating"), F.col("_top")).alias("similarity"))


def pair_loss(a: Column, b: Column, target: Column) -> Column:
    """Cross entropy between the target and the logistic of cosine over temperature."""
    p = 1.0 / (1.0 + F.exp(-cosine(a, b) / TEMPERATURE))
    return -(target * F.log(p + GUARD) + (1 - target) * F.log(1 - p + GUARD))


def mean_pooling(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key, dim (0 onwards), value: mean over the rows with mask 1 of each place; null where the mask is 0 throughout."""
    flat = tokens.select(key, F.col(mask).alias("_m"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "_h"))
    total = F.sum("_m")
    return flat.groupBy(key, "dim").agg(F.when(total != 0, F.sum(F.col("_h") * F.col("_m")) / total).alias("value"))


def hashing_encoder(width: int = WIDTH) -> Callable[[list[list[str]]], np.ndarray]:
    """A deterministic stand-in for a trained encoder: signed token hashes, one unit vector per text."""
    known: dict[str, int] = {}

    def encode(texts: list[list[str]]) -> np.ndarray:
        import zlib
        from itertools import chain

        for t in set(chain.from_iterable(texts)) - known.keys():
            h = zlib.crc32(t.encode())
            known[t] = 2 * ((h >> 1) % width) + (h & 1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        if len(known) > 500_000:  # a bounded memory of hashes already taken
            known.clear()
        counts = np.bincount(at + np.repeat(np.arange(len(texts)) * 2 * width, lengths), minlength=len(texts) * 2 * width).reshape(len(texts), width, 2)
        out = (counts[:, :, 1] - counts[:, :, 0]).astype(np.float64)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)

    return encode


def encode_texts(docs: DataFrame, key: str = "review_id", encoder: Callable[[list[list[str]]], np.ndarray] | None = None, batch: int = BATCH) -> DataFrame:
    """key, embedding (unit length; zeros without a token). Texts reach the encoder as tokens, `batch` at a time."""
    encode = encoder or hashing_encoder()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                vectors = encode([t or [] for t in piece.column(1).to_pylist()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "embedding"])

    return docs.select(F.col(key).cast("bigint").alias("id"), words(F.col("text"))).mapInArrow(run, "id bigint, embedding array<float>").withColumnRenamed("id", key)
