"""The regression forest of :mod:`panelforge.operators.trees` as a stage of a pipeline.

The model is its binned training rows: trees are grown again where they are asked for, because full trees have as many nodes as rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import trees
from panelforge.session import staged


def _slots(df: DataFrame, width: int) -> list:
    vector = vector_to_array("_features")
    return [vector[i].alias(f"_s{i}") for i in range(width)]


class ForestEstimator(Estimator):
    """Fits a forest on the vector ``_features``; a node may cut a third of the slots (all, if there is but one tree)."""

    def __init__(self, target: str, output: str, n_trees: int, depth: int, min_leaf: int, bins: int, seed: int):
        super().__init__()
        self.target, self.output, self.n_trees, self.depth, self.min_leaf, self.bins, self.seed = target, output, n_trees, depth, min_leaf, bins, seed

    def _fit(self, df: DataFrame) -> ForestModel:
        first = df.select(F.size(vector_to_array("_features")).alias("n")).first()
        if first is None:
            raise ValueError("no training rows")
        width = first["n"]
        # Draws depend on a row's values, and on its number among rows that are the same.
        named = [f.name for f in df.schema.fields if not f.name.startswith("_") and f.dataType.typeName() not in ("udt", "array", "map", "struct")]
        values = F.xxhash64(*named) if named else F.xxhash64(vector_to_array("_features"))
        keyed = df.select(F.col(self.target).cast("double").alias("_y"), *_slots(df, width), values.alias("_hash"))
        number = F.row_number().over(Window.partitionBy("_hash").orderBy("_y", *[f"_s{i}" for i in range(width)]))
        keyed = keyed.withColumn("_key", F.when(number == 1, F.col("_hash")).otherwise(F.xxhash64("_hash", number)))
        rows = trees.binned(keyed, [f"_s{i}" for i in range(width)], ["_key", "_y"], self.bins)
        per_node = 0 if self.n_trees == 1 else -(-width // 3)
        return ForestModel(rows, self.target, self.output, trees.Forest(self.n_trees, self.depth, self.min_leaf, per_node, self.seed))


class ForestModel(Model):
    def __init__(self, rows: trees.Binned, target: str, output: str, params: trees.Forest):
        super().__init__()
        self.rows, self.target, self.output, self.forest = rows, target, output, params

    @cached_property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name that tree models of Spark have
        return DenseVector(trees.forest_importances(self.rows, "_y", "_key", self.forest))

    def _transform(self, df: DataFrame) -> DataFrame:
        known = staged(df.withColumn("_row", F.monotonically_increasing_id()), name="forest-asked")
        asked = trees.binned(known.select("_row", *_slots(known, len(self.rows.features))), self.rows.features, ["_row"], cuts=self.rows.cuts)
        low = self.rows.rows.agg(F.min("_y")).first()[0]  # a target within the range of the others, which trains nothing
        both = self.rows.rows.select("_key", "_y", F.lit(True).alias("_train"), "bins").unionByName(
            asked.rows.select(F.col("_row").alias("_key"), F.lit(low).alias("_y"), F.lit(False).alias("_train"), "bins"))
        table = trees.Binned(both, self.rows.features, self.rows.cuts)
        found = trees.forest_predictions(table, "_y", "_key", {"forest": (F.col("_train"), ~F.col("_train"), self.rows.features)}, self.forest, ["_train"])
        found = found.where("not _train").select(F.col("_key").alias("_row"), F.col("prediction").alias(self.output))
        return known.join(found, "_row", "left").select(*df.columns, self.output)
