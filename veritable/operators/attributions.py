"""What each feature adds to a prediction: exact Shapley values of fitted tabular models.

Linear models: coefficient times the distance from the feature's mean, in logits. Trees: the
path-dependent game, in which a feature that is not known goes both ways, by how many training
rows went there. A leaf is a product over the features on its path, so its Shapley values are sums
over subsets of those alone; trees and leaves add up. Values of a row and the base add up
to the model's margin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.operators.shared import shared_dir


class Leaf:
    """value: what the leaf adds to the margin. tests: for each feature on its path the range
    (low, high] or the categories that lead there, and the share of rows that goes there anyway."""

    def __init__(self, value: float, tests: dict[int, tuple[float, float, frozenset[float] | None, float]]):
        self.value, self.tests = value, tests

    def passes(self, x: np.ndarray) -> np.ndarray:
        """[feature on the path, row]: 1 where the row goes the leaf's way."""
        out = np.empty((len(self.tests), len(x)))
        for k, (feature, (low, high, kinds, _)) in enumerate(self.tests.items()):
            v = x[:, feature]
            out[k] = (v > low) & (v <= high) & (True if kinds is None else np.isin(v, list(kinds)))
        return out

    def base(self) -> float:
        return self.value * float(np.prod([t[3] for t in self.tests.values()]))

    def shapley(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add this leaf's values to ``out`` [row, feature]."""
        n, passes = len(self.tests), self.passes(x)
        features, shares = list(self.tests), [t[3] for t in self.tests.values()]
        for i, feature in enumerate(features):
            rest = [k for k in range(n) if k != i]
            total = np.zeros(len(x))
            for size in range(n):
                weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                for known in combinations(rest, size):
                    product = np.full(len(x), weight)
                    for k in rest:
                        product *= passes[k] if k in known else shares[k]
                    total += product
            out[:, feature] += self.value * total * (passes[i] - shares[i])


def leaves(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    """The leaves of a tree of nodes by id (left, right, prediction, rows, feature, split)."""
    out: list[Leaf] = []

    def walk(at: int, tests: dict) -> None:
        node = nodes[at]
        if node["left"] < 0:
            out.append(Leaf(weight * node["prediction"], tests))
            return
        for side in ("left", "right"):
            child = nodes[node[side]]
            share = child["rows"] / node["rows"] if node["rows"] else 0.5
            low, high, kinds, before = tests.get(node["feature"], (-np.inf, np.inf, None, 1.0))
            if node["categories"] < 0:
                cut = node["split"][0]
                low, high = (low, min(high, cut)) if side == "left" else (max(low, cut), high)
            else:
                here = frozenset(node["split"]) if side == "left" else frozenset(map(float, range(node["categories"]))) - frozenset(node["split"])
                kinds = here if kinds is None else kinds & here
            walk(node[side], {**tests, node["feature"]: (low, high, kinds, before * share)})

    walk(0, {})
    return out


def _tree_leaves(model, spark) -> list[Leaf]:
    """The leaves of a fitted tree or ensemble, as its own saved table of nodes has them."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    trees: dict[int, dict[int, dict]] = {}
    for r in data.collect():  # a model's nodes
        n = r["nodeData"]
        trees.setdefault(r["treeID"], {})[n["id"]] = {"left": n["leftChild"], "right": n["rightChild"], "prediction": n["prediction"], "rows": n["rawCount"], "feature": n["split"]["featureIndex"], "split": list(n["split"]["leftCategoriesOrThreshold"]), "categories": n["split"]["numCategories"]}
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    return [leaf for t, nodes in sorted(trees.items()) for leaf in leaves(nodes, weights[t])]


def feature_means(model: PipelineModel, df: DataFrame) -> list[float]:
    from pyspark.ml.stat import Summarizer

    rows = PipelineModel(model.stages[:-1]).transform(df.withColumn("weight", F.lit(1.0)))
    return rows.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()


def shapley(model: PipelineModel, df: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """``df`` with shapley (array, a value for each model feature), base and margin: base and
    values add up to the margin, for every row. ``background``: the rows that a linear model's means
    are of (``df`` itself if None); trees bring their own counts."""
    last = model.stages[-1]
    rows = PipelineModel(model.stages[:-1]).transform(df.withColumn("weight", F.lit(1.0)))
    rows = rows.select(*df.columns, vector_to_array("features").alias("__features"))
    if hasattr(last, "coefficients"):
        weights, means = last.coefficients.toArray(), np.array(feature_means(model, df if background is None else background))
        base = float(weights @ means + last.intercept)
        values = F.transform("__features", lambda v, i: (v - F.get(F.array(*map(F.lit, means.tolist())), i)) * F.get(F.array(*map(F.lit, weights.tolist())), i))
        out = rows.select(*df.columns, values.alias("shapley"), F.lit(base).alias("base"))
        return out.withColumn("margin", F.col("base") + F.aggregate("shapley", F.lit(0.0), lambda a, v: a + v))
    found = _tree_leaves(last, df.sparkSession)
    base = sum(leaf.base() for leaf in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("__features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values, margin = np.zeros_like(x), np.zeros(len(x))
            for leaf in found:
                leaf.shapley(x, values)
                margin += leaf.value * leaf.passes(x).prod(0)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(values), pa.list_(pa.float64())), pa.array(np.full(len(x), base)), pa.array(margin)], [*batch.schema.names[:-1], "shapley", "base", "margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, shapley array<double>, base double, margin double")


def mean_magnitudes(values: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean_abs: the mean magnitude of each feature's values over all rows."""
    each = F.posexplode(F.transform("shapley", F.abs)).alias("at", "v")
    named = F.get(F.array(*map(F.lit, names)), F.col("at"))
    return values.select(each).groupBy(named.alias("feature")).agg(F.avg("v").alias("mean_abs"))
