"""Negative log-likelihoods as aggregate expressions over rows of residuals or rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian(r: Column, weight: Column | float = 1.0) -> Column:
    return 0.5 * F.sum(r * r * weight)


def variable_gaussian(r: Column, inverse_variance: Column) -> Column:
    return 0.5 * F.sum(r * r * inverse_variance - F.ln(inverse_variance))


def variable_gaussian_std(r: Column, inverse_std: Column) -> Column:
    return F.sum(0.5 * F.pow(r * inverse_std, 2) - F.ln(inverse_std))


def poissonian(d: Column, rate: Column) -> Column:
    """No constant of the factorial."""
    return F.sum(rate) - F.sum(d * F.ln(rate))


def inverse_gamma(x: Column, beta: Column | float, alpha: float = -0.5) -> Column:
    return F.sum((alpha + 1) * F.ln(x) + beta / x)


def student_t(r: Column, theta: float) -> Column:
    return F.sum(0.5 * (theta + 1) * F.log1p(r * r / theta))


def bernoulli(d: Column, p: Column) -> Column:
    return F.sum(-(d * F.ln(p)) + (d - 1) * F.ln(1 - p))


def categorical(d: Column, p: Column) -> Column:
    """One-hot d and probabilities."""
    return -F.sum(d * F.ln(p))


def categorical_logits(df: DataFrame, row: str, cls: str, logit: str, label: str) -> DataFrame:
    """Cross-entropy of logits (row, class, logit) with integer labels."""
    one = df.groupBy(row).agg(F.max(logit).alias("m"), F.collect_list(logit).alias("z"), F.max(F.when(F.col(cls) == F.col(label), F.col(logit))).alias("own"))
    return one.agg(F.sum(F.col("m") + F.ln(F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("m")))) - F.col("own")).alias("energy"))


def prior(xi: Column) -> Column:
    return 0.5 * F.sum(xi * xi)


def entropy(x: Column) -> Column:
    return -0.5 * F.sum(F.ln(2 * math.pi * math.e * x * x))
