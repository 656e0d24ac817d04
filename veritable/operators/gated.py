"""Fusing modalities by their features: the forward pass of small networks with given weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Layer = tuple[list[list[float]], list[float]]


def _numbers(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense(x: Column, layer: Layer, relu: bool = False) -> Column:
    """Rows of weights times x, and a bias each; cut off at zero if ``relu``."""
    weights, bias = layer
    rows = F.array(*(F.struct(_numbers(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias, strict=True)))
    out = _let(x, lambda y: F.transform(rows, lambda r: F.aggregate(F.zip_with(r["w"], y, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v) + r["b"]))
    return F.transform(out, lambda v: F.greatest(v, F.lit(0.0))) if relu else out


def network(x: Column, layers: list[Layer]) -> Column:
    """Layers with a cut at zero between them; the last one's only number."""
    for layer in layers[:-1]:
        x = dense(x, layer, relu=True)
    return F.get(dense(x, layers[-1]), F.lit(0))


def _sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def _times(x: Column, factor: Column) -> Column:
    return _let(factor, lambda f: F.transform(x, lambda v: v * f))


def concatenated(features: dict[str, Column], sizes: dict[str, int]) -> Column:
    """All features one after another, zeros in place of a modality that is null."""
    return F.concat(*(F.coalesce(f, F.array_repeat(F.lit(0.0), sizes[m])) for m, f in features.items()))


def feature_fusion(features: dict[str, Column], sizes: dict[str, int], layers: list[Layer]) -> Column:
    """The network's logit over all features; null where no modality is there."""
    some = F.coalesce(*features.values()).isNotNull()
    return F.when(some, network(concatenated(features, sizes), layers))


def gates(features: dict[str, Column], networks: dict[str, list[Layer]], softmax: bool = False) -> dict[str, Column]:
    """Each modality's gate from its own features: a sigmoid, or its share among those that are
    there. Null for an absent one."""
    raw = {m: F.when(f.isNotNull(), network(f, networks[m])) for m, f in features.items()}
    if not softmax:
        return {m: _sigmoid(v) for m, v in raw.items()}
    most = F.greatest(*raw.values(), F.lit(None).cast("double"))  # nulls are passed over
    weight = {m: F.exp(v - most) for m, v in raw.items()}
    total = sum((F.coalesce(w, F.lit(0.0)) for w in weight.values()), F.lit(0.0))
    return {m: w / total for m, w in weight.items()}


def gated_fusion(features: dict[str, Column], sizes: dict[str, int], networks: dict[str, list[Layer]], classifier: list[Layer], softmax: bool = False) -> Column:
    """logit and the gates, as a struct: features times their gates go through the classifier."""
    gate = gates(features, networks, softmax)
    weighted = {m: F.when(f.isNotNull(), _times(f, gate[m])) for m, f in features.items()}
    return F.struct(feature_fusion(weighted, sizes, classifier).alias("logit"), *(g.alias(m) for m, g in gate.items()))
