"""Principal components of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles


def project(points: DataFrame, k: int = 2, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the `keep` columns and pc1 .. pck of the centred vectors. Each component's largest loading is positive.

    The covariance is summed up in the executors; the driver decomposes a matrix of the width of one vector.
    """
    data = points.where(F.col(vector).isNotNull()).select(key, *keep, array_to_vector(doubles(F.col(vector))).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    out = model.transform(centred).withColumn("_p", vector_to_array("_p"))
    return out.select(key, *keep, *[(F.col("_p")[i] * F.lit(float(signs[i]))).alias(f"pc{i + 1}") for i in range(k)])
