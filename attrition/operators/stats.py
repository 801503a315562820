"""Correlation report."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import CATEGORICAL_FEATURES, LABEL, MODEL_COLUMNS

#: A column whose squared mean is this many times its variance loses half of a double's
#: digits in one pass; the moments are then taken once more around the means.
CANCELLATION = 1e6


def correlation_columns(columns: Sequence[str] = MODEL_COLUMNS, label: str = LABEL) -> list[str]:
    """Numeric and boolean model columns plus the label, in model order."""
    return [c for c in columns if c not in CATEGORICAL_FEATURES] + [label]


def co_moments(df: DataFrame, cols: Sequence[str], around: Sequence[float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(count, means, centred cross products) of the columns, from one pass.

    A row (1, x) adds its outer product to a (k + 1) x (k + 1) matrix that holds count,
    sums and cross products; partial matrices are added up in a tree, so one task or the
    driver sees a few matrices of that size, however many rows and partitions there are.
    ``around``: values to subtract from the columns first.
    """
    at = list(around) if around is not None else [0.0] * len(cols)
    cells = [F.lit(1.0).alias("_one")] + [(F.col(c).cast("double") - F.lit(float(a))).alias(f"_c{i}") for i, (c, a) in enumerate(zip(cols, at, strict=True))]
    names = ["_one", *(f"_c{i}" for i in range(len(cols)))]
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(df.select(*cells)).select("_v")
    # a row of zeros adds nothing; the matrix class wants one row at least
    rows = rows.unionAll(df.sparkSession.createDataFrame([(Vectors.sparse(len(names), {}),)], rows.schema))
    total = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "_v"), numCols=len(names)).computeGramianMatrix().toArray()
    n, sums, products = float(total[0, 0]), total[0, 1:], total[1:, 1:]
    if not n:
        return 0.0, np.full(len(cols), np.nan), np.full((len(cols), len(cols)), np.nan)
    return n, sums / n + np.array(at), products - np.outer(sums, sums) / n


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlations as (feature_a, feature_b, corr), rounded.

    The moments come from one pass over ``df``, nothing is cached, and only the k x k
    matrix (k = number of columns) comes back to the driver. A second pass around the
    means follows only where a column's values lie so close together, for their size,
    that the first one can't tell (``CANCELLATION``). A constant column has no
    correlation: null. A null value in a column is an error, as for the models.
    """
    cols = list(columns or correlation_columns())
    n, mean, centred = co_moments(df, cols)
    spread = np.diag(centred)
    with np.errstate(invalid="ignore", divide="ignore"):
        if n and (n * mean**2 > CANCELLATION * np.abs(spread)).any():
            _, _, centred = co_moments(df, cols, mean)
            spread = np.diag(centred)
        # differences of one value from its rounded mean are no variance
        noise = n * (4 * np.finfo(float).eps * np.abs(mean)) ** 2
        spread = np.where(spread > noise, spread, np.nan)
        matrix = centred / np.sqrt(np.outer(spread, spread))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = 1.0 if i == j and not math.isnan(matrix[i][i]) else float(matrix[i][j])
            rows.append((a, b, None if math.isnan(v) else v))
    out = df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")
    return out.withColumn("corr", F.round("corr", digits))
