"""Parameter bundle of a detector: features, scaling, threshold and the scorer's weights."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from tidewatch.functions.names import state_names
from tidewatch.plans import files


class BundleMissingError(FileNotFoundError):
    """No bundle at that place: scoring is off, every other query still works."""


@dataclass(frozen=True)
class Bundle:
    feature_cols: list[str]
    scaler_mean: list[float]
    scaler_scale: list[float]
    seq_len: int = 5
    threshold: float = 0.5
    k_steps: int = 5
    window_size: str = "1min"
    baseline: dict | None = None
    hidden_size: int = 256
    num_layers: int = 2
    weights: dict = field(default_factory=dict)

    def __post_init__(self):
        width = 4 * len(self.feature_cols) + 4
        if len(self.scaler_mean) != width or len(self.scaler_scale) != width:
            raise ValueError(f"the scaler must have {width} entries")
        if any(s == 0 for s in self.scaler_scale):
            raise ValueError("a scale of 0 cannot standardise")

    @property
    def names(self) -> list[str]:
        return state_names(self.feature_cols)

    @property
    def spark_window(self) -> str:
        """Window size as an interval Spark reads."""
        return f"{int(pd.Timedelta(self.window_size).total_seconds() * 1e6)} microseconds"


# Entries of the JSON part; the weights are the arrays of the .npz part.
_PLAIN = (
    "feature_cols scaler_mean scaler_scale seq_len threshold k_steps window_size baseline "
    "hidden_size num_layers"
).split()


def save_bundle(bundle: Bundle, folder: str, spark: SparkSession | None = None) -> None:
    """Write a bundle to any folder that the session reaches."""
    spark = spark or SparkSession.active()
    plain = json.dumps({name: getattr(bundle, name) for name in _PLAIN})
    arrays = io.BytesIO()
    np.savez(arrays, **bundle.weights)
    files.write_bytes(spark, f"{folder}/weights.npz", arrays.getvalue())
    files.write_bytes(spark, f"{folder}/bundle.json", plain.encode())


def load_bundle(folder: str, spark: SparkSession | None = None) -> Bundle:
    """Read a bundle on the driver; its few megabytes reach executors as one broadcast."""
    spark = spark or SparkSession.active()
    if not files.exists(spark, f"{folder}/bundle.json"):
        raise BundleMissingError(f"no bundle in {folder}")
    plain = json.loads(files.read_bytes(spark, f"{folder}/bundle.json"))
    with np.load(io.BytesIO(files.read_bytes(spark, f"{folder}/weights.npz"))) as stored:
        weights = {name: stored[name] for name in stored.files}
    return Bundle(**plain, weights=weights)


def seeded_lstm_weights(
    state_dim: int, hidden: int = 256, layers: int = 2, classes: int = 7, seed: int = 7
) -> dict[str, np.ndarray]:
    """Weights of the right shapes from a seeded generator, for tests and benchmarks."""
    rng = np.random.default_rng(seed)
    shapes: dict[str, tuple[int, ...]] = {}
    for layer in range(layers):
        width = state_dim if layer == 0 else hidden
        shapes[f"lstm.weight_ih_l{layer}"] = (4 * hidden, width)
        shapes[f"lstm.weight_hh_l{layer}"] = (4 * hidden, hidden)
        shapes[f"lstm.bias_ih_l{layer}"] = (4 * hidden,)
        shapes[f"lstm.bias_hh_l{layer}"] = (4 * hidden,)
    for head, inner, outer in (
        ("state_head", hidden, state_dim),
        ("attack_head", 64, 1),
        ("mitre_head", 64, classes),
    ):
        shapes[f"{head}.0.weight"], shapes[f"{head}.0.bias"] = (inner, hidden), (inner,)
        shapes[f"{head}.3.weight"], shapes[f"{head}.3.bias"] = (outer, inner), (outer,)
    bound = 1.0 / np.sqrt(hidden)
    weights = {
        name: rng.uniform(-bound, bound, shape).astype(np.float32)
        for name, shape in shapes.items()
    }
    weights["ln.weight"] = rng.uniform(0.5, 1.5, hidden).astype(np.float32)
    weights["ln.bias"] = rng.uniform(-0.1, 0.1, hidden).astype(np.float32)
    return weights
