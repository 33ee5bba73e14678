"""Scalar functions: strings, intervals, number forms, normal distribution, geometry, control parameters."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf


def words(text: Column, delimiters: str) -> Column:
    """Parts of a text between any of the delimiter characters, empty parts dropped."""
    pattern = "[" + "".join("\\" + c for c in delimiters) + "]"
    return F.filter(F.split(text, pattern), lambda x: x != "")


def is_substring(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """Whether either text contains the other."""
    a, b = (a, b) if case_sensitive else (F.lower(a), F.lower(b))
    return a.contains(b) | b.contains(a)


def time_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def quarter_form(x: Column) -> tuple[Column, Column]:
    """(m, r) with x = 4^m * r and 1/4 <= r < 1, for x > 0."""
    m = F.floor(F.round(F.log(x) / math.log(4), 12)) + 1
    return m, x / F.pow(F.lit(4.0), m)


@pandas_udf(T.DoubleType())
def normal_cdf(x, mean, sd):  # noqa: ANN001
    import numpy as np

    z = (x - mean) / (sd * math.sqrt(2))
    return (0.5 * (1 + z.map(math.erf))).where(np.isfinite(z), (z > 0).astype(float))


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return NormalDist(mean, sd).inv_cdf(p)


def interval_lookup(points: DataFrame, domain: DataFrame) -> DataFrame:
    """For each x the largest domain value at or below it and the smallest at or above it; x itself inside an interval.

    ``points``: (x); ``domain``: (lo, hi), one row for each of a fixed number of intervals. Below all
    intervals the floor is -Infinity, above all the ceiling is Infinity."""
    d = F.broadcast(domain.select(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))
    x = F.col("x")
    inside = F.max(F.when((F.col("lo") <= x) & (x <= F.col("hi")), x))
    floor, ceiling = F.max(F.when(F.col("hi") <= x, F.col("hi"))), F.min(F.when(F.col("lo") >= x, F.col("lo")))
    return points.join(d, F.lit(True), "left").groupBy("x").agg(F.coalesce(inside, floor, F.lit(float("-inf"))).alias("floor"), F.coalesce(inside, ceiling, F.lit(float("inf"))).alias("ceiling"))


def boxed(value: Column, x: Column, low: float, high: float) -> Column:
    """``value`` where x lies in the box, else infinity."""
    return F.when((x >= low) & (x <= high), value).otherwise(float("inf"))


def interpolated(x: Column, a: Column, fa: Column, b: Column, fb: Column) -> Column:
    """The line through (a, fa) and (b, fb) at x; fa where a = b."""
    return F.when(a == b, fa).otherwise(fa + (fb - fa) * (x - a) / (b - a))


def ellipse_area(m: list[list[float]]) -> float:
    """Area of {M u + c : |u| <= 1}: pi times the product of the singular values of M."""
    import numpy as np

    return math.pi * float(np.prod(np.linalg.svd(np.array(m, float), compute_uv=False)))


def lambda_from_c(c: float, nodes: int, n: int) -> float:
    return c * math.sqrt(math.log(nodes) / n)


def group_control(states: int, n: int, nodes: int) -> float:
    return math.sqrt(math.log(nodes - 1) / n) + (states - 1) / (4 * math.sqrt(n))


def c_from_incoherence(alpha: float) -> float:
    return 8 * (2 - alpha) / alpha
