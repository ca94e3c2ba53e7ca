"""Scalar functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_rca.functions.numeric import erf


def path_mean(probs: Column, method: str = "arithmetic") -> Column:
    """Mean of a path's edge probabilities; geometric and harmonic leave out those equal to 1 and are NULL if none is left."""
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, x: s + x)
    if method == "arithmetic":
        return F.when(F.size(probs) == 0, 0.0).otherwise(total(probs, lambda x: x) / F.size(probs))
    kept = F.filter(probs, lambda x: x != 1)
    n = F.when(F.size(kept) > 0, F.size(kept))
    if method == "geometric":
        return F.exp(total(kept, F.ln) / n)
    if method == "harmonic":
        return n / total(kept, lambda x: 1 / x)
    raise ValueError(f"unknown mean {method!r}")


@F.pandas_udf(T.DoubleType())
def erf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(erf(x.to_numpy(dtype=float)))


def abnormality(cur: Column, mean: Column, std: Column) -> Column:
    """Chance that a normal sample lies nearer to the mean: erf(|cur - mean| / (sqrt(2) std)); NULL if std is 0."""
    return erf_udf(F.abs(cur - mean) / F.when(std > 0, std * float(np.sqrt(2))))


def scaled_diff(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.abs(a - b) / F.when(hi > lo, hi - lo)


def tail_quantile(q: float, n: Column, peaks: Column, t: Column, gamma: Column, sigma: Column) -> Column:
    """Level that a share q of values exceeds, from a generalized Pareto tail over threshold t."""
    r = n * q / peaks
    return F.when(gamma == 0, t - sigma * F.ln(r)).otherwise(t + sigma / F.when(gamma != 0, gamma) * (F.pow(r, -gamma) - 1))


def format_result(prks: Column, acc: Column, style: str = "excel") -> Column:
    """PR@1..5, their mean and the accuracy as text: four decimals, or percent with two and & in latex."""
    mean = F.aggregate(prks, F.lit(0.0), lambda s, x: s + x) / F.size(prks)
    values = [F.get(prks, i) for i in range(5)] + [mean, acc]
    if style == "latex":
        return F.concat_ws(" & ", *[F.format_string("%.2f", v * 100) for v in values])
    return F.concat_ws("\t", *[F.format_string("%.4f", v) for v in values])
