"""Scorers: sequence in, predicted next state, forecast logits and attribution out.

A scorer is called as ``scorer(seq, k_steps)`` on an ``array<array<float>>`` column and
returns a struct column: ``pred_state`` array, ``steps`` array of (``logit``,
``class_logits``) with the sequence's own output first, ``importance`` array per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import lstm
from tidewatch.functions.numeric import double_array

Scorer = Callable[[Column, int], Column]

OUTPUT_TYPE = (
    "pred_state array<float>, steps array<struct<logit:float,class_logits:array<float>>>, "
    "importance array<float>"
)
# Sequences evaluated at once inside one Arrow batch; bounds the worker's memory.
SLICE = 512


def _lists(values: np.ndarray) -> pa.ListArray:
    """(n, m) array as n lists of m floats."""
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float32).ravel())
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _arrow_result(state, logits, classes, importance) -> pa.StructArray:
    count, steps = logits.shape
    step = pa.StructArray.from_arrays(
        [
            pa.array(logits.astype(np.float32).ravel()),
            _lists(classes.reshape(count * steps, -1)),
        ],
        names=["logit", "class_logits"],
    )
    offsets = pa.array(np.arange(0, count * steps + 1, steps, dtype=np.int32))
    return pa.StructArray.from_arrays(
        [_lists(state), pa.ListArray.from_arrays(offsets, step), _lists(importance)],
        names=["pred_state", "steps", "importance"],
    )


def lstm_scorer(
    spark: SparkSession, weights: dict[str, np.ndarray], layers: int = 2
) -> Scorer:
    """Scorer around the sequence network; its weights are broadcast once."""
    single = {name: np.asarray(w, dtype=np.float32) for name, w in weights.items()}
    shared = spark.sparkContext.broadcast(single)

    def scorer(seq: Column, k_steps: int) -> Column:
        @F.arrow_udf(OUTPUT_TYPE)
        def score(batch: pa.Array) -> pa.Array:
            w = shared.value
            dim = w["lstm.weight_ih_l0"].shape[1]
            cells = batch.flatten().flatten().to_numpy()
            x = cells.reshape(len(batch), -1, dim) if len(batch) else cells.reshape(0, 1, dim)
            parts = [
                lstm.score_batch(w, layers, k_steps, x[at : at + SLICE])
                for at in range(0, max(len(x), 1), SLICE)
            ]
            return _arrow_result(*[np.concatenate(p) for p in zip(*parts)])

        return score(seq)

    return scorer


def _dot(values: Column, weights: Column) -> Column:
    products = F.zip_with(values, weights, lambda v, w: v * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


@dataclass(frozen=True)
class LinearScorer:
    """Scorer without Python: the next state is ``decay * last + drift`` per dimension, the
    logits are weighted sums of the last state."""

    attack: Sequence[float]
    classes: Sequence[Sequence[float]]
    attack_bias: float = 0.0
    decay: float = 0.9
    drift: float = 0.0

    def __call__(self, seq: Column, k_steps: int) -> Column:
        last = F.get(seq, F.size(seq) - 1).cast("array<double>")
        attack = double_array(self.attack)
        classes = F.array(*[double_array(c) for c in self.classes])
        ahead = [(1.0, 0.0)]
        for _ in range(k_steps):
            factor, added = ahead[-1]
            ahead.append((factor * self.decay, added * self.decay + self.drift))

        def moved(by: Column) -> Column:
            """State some steps on; ``by`` is (factor, addition) for that many steps."""
            return F.transform(last, lambda v: v * F.get(by, F.lit(0)) + F.get(by, F.lit(1)))

        def outputs(by: Column) -> Column:
            state = moved(by)
            return F.struct(
                (_dot(state, attack) + F.lit(self.attack_bias)).alias("logit"),
                F.transform(classes, lambda w: _dot(state, w)).alias("class_logits"),
            )

        # The gradient of a weighted sum is its weights, at the last step only.
        importance = F.zip_with(
            last, attack, lambda v, w: F.abs(v * w) / F.size(seq).cast("double")
        )
        steps = F.array(*[double_array(pair) for pair in ahead[:k_steps]])
        return F.struct(
            moved(double_array(ahead[1])).alias("pred_state"),
            F.transform(steps, outputs).alias("steps"),
            importance.alias("importance"),
        )
