"""Least squares on harmonic features, fitted per group by distributed normal equations.

Each row contributes its outer products to plain SUM aggregates, so the fit is
one partial aggregation and one shuffle of a fixed number of sums per group;
only those sums reach Python, where the small systems are solved in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def harmonic_features(t: Column, period: float, harmonics: int, trend_scale: float) -> list[Column]:
    """1, a scaled trend and `harmonics` sine/cosine pairs of `period`, from the numeric time `t`."""
    out = [F.lit(1.0), t / F.lit(float(trend_scale))]
    for k in range(1, harmonics + 1):
        angle = t * F.lit(2 * math.pi * k / period)
        out += [F.sin(angle), F.cos(angle)]
    return out


def fit_normal_equations(df: DataFrame, keys: Sequence[str], y: str, features: Sequence[Column], ridge: float = 1e-3) -> DataFrame:
    """Columns `keys`, `beta array<double>`, `n_fit bigint` with the ridge solution per group.

    Rows with a null in `y` or a feature don't count. The ridge grows with the
    group's size and keeps systems with few rows solvable; a group of one row
    gets nearly a constant.
    """
    p = len(features)
    x = df.select(*keys, F.col(y).cast("double").alias("_y"), *[f.cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    x = x.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    sums = x.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in cells]).alias("_xx"),
        F.array(*[F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(p)]).alias("_xy"),
        F.count(F.lit(1)).alias("n_fit"),
    )
    return solve_sums(sums, keys, p, ridge)


def solve_sums(sums: DataFrame, keys: Sequence[str], p: int, ridge: float = 1e-3) -> DataFrame:
    """keys, beta, n_fit from one row a group: `_xx`, the sums of products of the p features (upper triangle by rows), `_xy` and `n_fit`."""
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    rows, cols = [i for i, _ in cells], [j for _, j in cells]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            a = np.zeros((len(b), p, p))
            v = np.array([[0.0 if c is None else c for c in r] for r in b["_xx"]])
            a[:, rows, cols] = v
            a[:, cols, rows] = v
            rhs = np.array([[0.0 if c is None else c for c in r] for r in b["_xy"]])
            n = b["n_fit"].to_numpy(dtype=float)
            a[:, range(1, p), range(1, p)] += ridge * (1.0 + n)[:, None]
            a[:, 0, 0] += 1e-9
            beta = np.linalg.solve(a, rhs[:, :, None])[:, :, 0]
            yield b[list(keys)].assign(beta=list(beta), n_fit=b["n_fit"])

    schema = T.StructType([*[sums.schema[k] for k in keys], T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("n_fit", T.LongType())])
    return sums.mapInPandas(solve, schema)


def predict(beta: Column, features: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for i, f in enumerate(features):
        total = total + F.element_at(beta, i + 1) * f
    return total
