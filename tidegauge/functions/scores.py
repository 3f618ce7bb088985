"""Statistical expressions on the four known metrics, null where a metric is missing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import METRICS, OTHER_WEIGHT, PRIORS, precision


def source_weight(source: Column, weights: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(source)), F.lit(OTHER_WEIGHT))


def z_score(metric: str, value: Column) -> Column:
    mean, std, _, _ = PRIORS[metric]
    return (value - mean) / std


def out_of_bounds(metric: str, value: Column) -> Column:
    """Strictly outside the physical limits; a missing value or NaN is not."""
    _, _, low, high = PRIORS[metric]
    return F.coalesce(~F.isnan(value) & ((value < low) | (value > high)), F.lit(False))


def mahalanobis_sq(values: Mapping[str, Column]) -> Column:
    """Quadratic form of the differences from the means; a missing metric differs by 0."""
    p = precision()
    diff = [F.coalesce(values[m] - PRIORS[m][0], F.lit(0.0)) for m in METRICS]
    terms = [F.lit(float(p[i][j]) * (1 if i == j else 2)) * diff[i] * diff[j] for i in range(4) for j in range(i, 4)]
    return reduce(lambda a, b: a + b, terms)


def contributing(values: Mapping[str, Column], limit: float = 2.0) -> Column:
    """Names of the metrics more than `limit` standard deviations off, in the usual order."""
    return F.array_compact(F.array(*[F.when(F.abs(z_score(m, values[m])) > limit, F.lit(m)) for m in METRICS]))
