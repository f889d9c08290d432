"""Synthetic series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package


def rednoise(spark: SparkSession, a: float, ntime: int = 100, nsamples: int = 1, mean: float = 0.0, stdev: float = 1.0, seed: int = 0) -> DataFrame:
    """(sample, t, v): first-order autoregressions from zero, one seed a sample."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for k in batch["id"]:
                noise = np.random.default_rng([seed, int(k)]).standard_normal(ntime - 1) * np.sqrt(1 - a * a)
                x = np.zeros(ntime)
                for t in range(1, ntime):
                    x[t] = a * x[t - 1] + noise[t - 1]
                yield pd.DataFrame({"sample": k, "t": np.arange(ntime), "v": mean + stdev * x})

    return spark.range(nsamples).mapInPandas(run, "sample long, t int, v double")


def waves(x: Column, wavenums: list[float] | None = None, wavelengths: list[float] | None = None, phase: float | list[float] = 0.0) -> Column:
    """Sum of sines of ``x`` as one expression."""
    k = list(wavenums) if wavenums is not None else [1 / w for w in wavelengths or []]
    phases = phase if isinstance(phase, (list, tuple)) else [phase] * len(k)
    return sum((F.sin(x * (2 * np.pi * n) + p) for n, p in zip(k, phases, strict=True)), F.lit(0.0))
