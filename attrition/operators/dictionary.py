"""Distributed level dictionary of the encoder (M4).

Each category column's distinct levels are found by one aggregate (levels combine
before the shuffle) and numbered in order, by a distributed sort where a column has many;
the numbers are the one-hot slots. No list of levels comes to the driver, only the number of levels of
each column. Rows get their slots by a join with the dictionary:

* a column of up to ``BROADCAST_LEVELS`` levels: the dictionary is broadcast, its size
  being known by then;
* beyond that: its frequent levels (at least one row in ``HEAVY_SHARE``, so at most
  that many) are broadcast and the others shuffled; rows of frequent levels are dealt
  over all tasks in the shuffle by a hash of all their columns (an id among them tells
  them apart), so one level with a third of the rows fills none.

Levels are ordered by their UTF-8 bytes. A level that the fitted rows lack has no slot:
its row's one-hot part is all zeros. A null is no level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import CATEGORICAL_FEATURES, MODEL_COLUMNS
from attrition.operators.ranking import exact_row_number
from attrition.session import ensure_checkpoint_dir

FEATURES = "features"
BROADCAST_LEVELS = 100_000
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class LevelEncoder:
    """One-hot slots of the fitted levels, then the pass-through columns in order."""

    levels: DataFrame  # column, level, position (from 0, in the column), n
    sizes: dict[str, int]  # levels of each category column, in slot order
    rest: tuple[str, ...]

    @property
    def width(self) -> int:
        return sum(self.sizes.values()) + len(self.rest)

    def offset(self, column: str) -> int:
        before = list(self.sizes)
        return sum(self.sizes[c] for c in before[: before.index(column)])

    def features(self) -> DataFrame:
        """(slot, feature): the name of each slot of the vector."""
        at = F.lit(None).cast("long")
        for c in self.sizes:
            at = F.when(F.col("column") == c, F.lit(self.offset(c))).otherwise(at)
        hot = self.levels.select((at + F.col("position")).alias("slot"), F.concat("column", F.lit("="), "level").alias("feature"))
        first = sum(self.sizes.values())
        plain = self.levels.sparkSession.createDataFrame([(first + i, c) for i, c in enumerate(self.rest)], "slot long, feature string")
        return hot.unionByName(plain)

    def with_positions(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>__at``: the level's number in its column, null if it has none."""
        for c, size in self.sizes.items():
            mine = self.levels.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("position").alias("_at"), "n")
            key = F.col(f"`{c}`").cast("string")
            if size <= BROADCAST_LEVELS:
                df = df.join(F.broadcast(mine.drop("n")), key == F.col("_level"), "left")
            else:
                total = self.levels.where(F.col("column") == c).agg(F.sum("n")).first()[0]
                frequent = F.col("n") * HEAVY_SHARE >= total
                heavy = mine.where(frequent).select(F.col("_level").alias("_heavy"), F.col("_at").alias("_heavy_at"))
                light = mine.where(~frequent).drop("n")
                dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(1 << 16)).cast("string"))
                df = df.join(F.broadcast(heavy), key == F.col("_heavy"), "left")
                df = df.withColumn("_key", F.when(F.col("_heavy").isNull(), F.coalesce(key, dealt)).otherwise(dealt))
                df = df.join(light, (F.col("_key") == F.col("_level")) & F.col("_heavy").isNull() & key.isNotNull(), "left")
                df = df.withColumn("_at", F.coalesce("_heavy_at", "_at")).drop("_heavy", "_heavy_at", "_key")
            df = df.withColumnRenamed("_at", f"{c}__at").drop("_level")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the feature vector (sparse) in ``features``."""
        placed = self.with_positions(df)
        kept = [c for c, size in self.sizes.items() if size]
        for c in kept:
            size = self.sizes[c]
            number = F.coalesce(F.col(f"{c}__at"), F.lit(size)).cast("double")  # the last one has no slot
            placed = placed.withColumn(f"{c}__idx", number.alias(f"{c}__idx", metadata={"ml_attr": {"type": "nominal", "num_vals": size + 1}}))
        if kept:
            hot = OneHotEncoder(inputCols=[f"{c}__idx" for c in kept], outputCols=[f"{c}__ohe" for c in kept], dropLast=True)
            placed = hot.fit(placed).transform(placed)  # sizes are declared: no job
        for c in kept:  # the declared names of the slots are of no use: their number will do
            placed = placed.withColumn(f"{c}__ohe", F.col(f"{c}__ohe").alias(f"{c}__ohe", metadata={"ml_attr": {"num_attrs": self.sizes[c]}}))
        out = VectorAssembler(inputCols=[f"{c}__ohe" for c in kept] + list(self.rest), outputCol="_vector").transform(placed)
        vector = F.col("_vector").alias(FEATURES, metadata={"ml_attr": {"num_attrs": self.width}})
        return out.withColumn(FEATURES, vector).drop("_vector", *[f"{c}__{x}" for c in kept for x in ("idx", "ohe")])

    def explode(self, df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
        """Long form (keys..., feature, value) of the non-zero slots of each row, one cell
        for each category column and pass-through column (and column of ``extra``)."""
        placed = self.with_positions(df)
        cells = []
        for c in self.sizes:
            has = F.when(F.col(f"{c}__at").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
            cells.append(F.struct(F.concat(F.lit(f"{c}="), F.col(f"`{c}`")).alias("feature"), has.alias("value")))
        for c in [*self.rest, *extra]:
            cells.append(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")))
        long = placed.select(*keys, F.explode(F.array(*cells)).alias("_cell"))
        return long.where(F.col("_cell.value") != 0.0).select(*keys, "_cell.feature", "_cell.value")


def fit_levels(train: DataFrame, categoricals: Sequence[str] = CATEGORICAL_FEATURES, columns: Sequence[str] = MODEL_COLUMNS) -> LevelEncoder:
    """The dictionary of the levels in ``train``, written once to the checkpoint folder."""
    ensure_checkpoint_dir(train.sparkSession)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in categoricals])
    found = train.select(F.inline(cells)).where("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    found = found.checkpoint(eager=True)
    count = {r.column: r.levels for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("levels")).collect()}
    if max(count.values(), default=0) <= BROADCAST_LEVELS:
        numbered = found.withColumn("_number", F.row_number().over(Window.partitionBy("column").orderBy("level")))
    else:
        numbered = exact_row_number(found, ["column"], ["level"], out="_number")
    levels = numbered.select("column", "level", (F.col("_number") - 1).cast("long").alias("position"), "n").checkpoint(eager=True)
    return LevelEncoder(levels, {c: count.get(c, 0) for c in categoricals}, tuple(c for c in columns if c not in categoricals))


__all__ = ["BROADCAST_LEVELS", "FEATURES", "LevelEncoder", "fit_levels"]
