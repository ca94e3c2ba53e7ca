"""Spline filling of missing samples, one series at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from spark_rca.functions.numeric import spline


def fill_spline(metrics: DataFrame, method: str = "cubic") -> DataFrame:
    """Zeros replaced by a quadratic or cubic spline through the other samples; all-zero series stay 0."""
    degree = {"quadratic": 2, "cubic": 3}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, v = pdf["t"].to_numpy(float), pdf["value"].to_numpy(float)
        on = v != 0
        return pdf.assign(value=v if on.all() or not on.any() else pd.Series(v).where(on, spline(t[on], v[on], t, degree)).to_numpy())

    return metrics.select("incident_id", "service_id", "t", "value").groupBy("incident_id", "service_id").applyInPandas(run, "incident_id string, service_id int, t long, value double")
