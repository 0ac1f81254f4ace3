"""Exact integer networks: int8 weights, int32 accumulators, rounding shifts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest accumulator that a layer may reach.
LIMIT = 1 << 30


@dataclass(frozen=True)
class Layer:
    weights: np.ndarray  # outputs x inputs, int8
    bias: np.ndarray
    shift: int
    hidden: bool


def formula_layer(inputs: int, outputs: int, hidden: bool, bias: int = 100, shift: int = 9) -> Layer:
    """A layer whose weights follow a rule, for tests and throughput."""
    w = (np.arange(inputs * outputs) * 37 % 255).astype(np.uint8).view(np.int8)
    return Layer(w.reshape(outputs, inputs), np.full(outputs, bias, np.int64), shift, hidden)


def overflow_bound(layer: Layer, largest: int = 128) -> np.ndarray:
    """The largest magnitude that each accumulator can reach."""
    return np.abs(layer.bias) + np.abs(layer.weights.astype(np.int64)).sum(axis=1) * largest


def validate(layers: list[Layer]) -> None:
    """Raises if some accumulator could overflow for some input, or layers don't fit."""
    for k, layer in enumerate(layers):
        if (overflow_bound(layer, 128 if k == 0 else 127) > LIMIT).any():
            raise ValueError(f"layer {k} can overflow its accumulators")
        if k and layers[k - 1].weights.shape[0] != layer.weights.shape[1]:
            raise ValueError(f"layer {k} has {layer.weights.shape[1]} inputs, not {layers[k - 1].weights.shape[0]}")


def apply_layer(x: np.ndarray, layer: Layer) -> np.ndarray:
    """One layer over a batch. Products of int8 stay below 2^24, so float32 blocks would do; float64 is exact throughout."""
    acc = (x.astype(np.float64) @ layer.weights.T.astype(np.float64)).astype(np.int64) + layer.bias
    if not layer.hidden:
        return acc
    if layer.shift:
        acc = (acc + (1 << (layer.shift - 1))) >> layer.shift
    return np.clip(acc, 0, 127)


def forward(x: np.ndarray, layers: list[Layer]) -> np.ndarray:
    for layer in layers:
        x = apply_layer(x, layer)
    return x


def forward_column(inputs: Column, layers: list[Layer]) -> Column:
    """The network's raw outputs for a column of input arrays of one length."""
    validate(layers)
    width = layers[0].weights.shape[1]

    def run(rows: pa.Array) -> pa.Array:
        flat = np.asarray(rows.flatten(), np.int64).reshape(-1, width)
        out = forward(flat, layers)
        bounds = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel(), pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(inputs)


def dense(inputs: Column, layer: Layer) -> Column:
    """One layer in column functions: what forward_column() is held against."""

    def one(weights: np.ndarray, bias: int) -> Column:
        w = F.array(*[F.lit(int(v)).cast("bigint") for v in weights])
        acc = F.aggregate(F.zip_with(inputs, w, lambda a, b: a.cast("bigint") * b), F.lit(int(bias)).cast("bigint"), lambda s, v: s + v)
        if not layer.hidden:
            return acc
        if layer.shift:
            acc = F.call_function("shiftright", acc + (1 << (layer.shift - 1)), F.lit(layer.shift))
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(127).cast("bigint"), acc))

    return F.array(*[one(w, b) for w, b in zip(layer.weights, layer.bias, strict=True)])




def exponents(largest_weight: float, largest_activation: float, input_exponent: int) -> tuple[int, int, int]:
    """Power-of-two scales of a layer: of its weights, of its activations, and the shift between them."""
    weight = math.floor(math.log2(127 / (largest_weight or 1e-3)))
    activation = math.floor(math.log2(127 / max(largest_activation, 1e-3)))
    shift = weight + input_exponent - activation
    return (weight, activation, shift) if shift >= 0 else (weight, activation + shift, 0)
