"""One-hot encoding with a pass-through remainder (M4, M5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import CATEGORICAL_FEATURES, MODEL_COLUMNS

FEATURES = "features"


def encoder(
    categoricals: Sequence[str] = CATEGORICAL_FEATURES,
    columns: Sequence[str] = MODEL_COLUMNS,
    out: str = FEATURES,
) -> Pipeline:
    """Encoded categoricals first, then the other model columns in order.

    StringIndexer(keep) puts unseen values in an extra last slot and
    OneHotEncoder(dropLast) drops exactly that slot: every seen level gets a
    column and an unseen value encodes as all zeros.
    """
    rest = [c for c in columns if c not in categoricals]
    idx = StringIndexer(
        inputCols=list(categoricals),
        outputCols=[f"{c}__idx" for c in categoricals],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    ohe = OneHotEncoder(
        inputCols=[f"{c}__idx" for c in categoricals],
        outputCols=[f"{c}__ohe" for c in categoricals],
        dropLast=True,
    )
    assembler = VectorAssembler(inputCols=[f"{c}__ohe" for c in categoricals] + rest, outputCol=out)
    return Pipeline(stages=[idx, ohe, assembler])


def feature_names(df: DataFrame, col: str = FEATURES) -> list[str]:
    """Names of the assembled vector's slots: ``column=value`` for one-hot slots."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    names = []
    for _, name in slots:
        if "__ohe_" in name:
            base, value = name.split("__ohe_", 1)
            names.append(f"{base}={value}")
        else:
            names.append(name)
    return names


def explode_features(
    encoded: DataFrame, keys: Sequence[str], categoricals: Sequence[str] = CATEGORICAL_FEATURES, columns: Sequence[str] = MODEL_COLUMNS
) -> DataFrame:
    """Long form (keys..., feature, value) of the non-zero slots of each row.

    Built from the category columns (one slot each, if the level has one) and the
    pass-through columns, not from the vector's full width."""
    cells = []
    for c in categoricals:
        seen = F.col(f"{c}__idx") < F.lit(len(_levels(encoded, c)))
        cells.append(F.struct(F.concat(F.lit(f"{c}="), F.col(c)).alias("feature"), F.when(seen, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value")))
    for c in columns:
        if c not in categoricals:
            cells.append(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")))
    long = encoded.select(*keys, F.explode(F.array(*cells)).alias("_cell"))
    return long.where(F.col("_cell.value") != 0.0).select(*keys, "_cell.feature", "_cell.value")


def _levels(encoded: DataFrame, column: str) -> list[str]:
    """Levels with a slot: those that the indexer saw."""
    return [a["name"] for a in encoded.schema[f"{column}__ohe"].metadata["ml_attr"]["attrs"]["binary"]]


def fit_encoder(train: DataFrame, **kw) -> PipelineModel:
    return encoder(**kw).fit(train)
