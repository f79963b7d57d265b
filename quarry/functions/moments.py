"""Moment expressions in the reference's forms, built on Spark's aggregates.

Spark's ``skewness``/``kurtosis`` are the population forms
(m3/m2^1.5 and m4/m2^2 - 3). The reference divides the population
third/fourth moment by the *sample* sd, which is a fixed rescaling:

    skew_ref = skewness * ((n-1)/n)^1.5          (NULL if n < 3 or sd = 0)
    kurt_ref = (kurtosis + 3) * ((n-1)/n)^2 - 3  (NULL if n < 4 or sd = 0)

Both stay inside one aggregate, so one pass computes them for every column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_present(c: Column) -> Column:
    return F.count(c)


def sample_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    sd = F.stddev_samp(c)
    return F.when((n >= 3) & (sd > 0), F.skewness(c) * F.pow((n - 1) / n, 1.5))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    sd = F.stddev_samp(c)
    return F.when((n >= 4) & (sd > 0),
                  (F.kurtosis(c) + 3.0) * F.pow((n - 1) / n, 2.0) - 3.0)


def pop_skewness(c: Column) -> Column:
    return F.skewness(c)


def pop_excess_kurtosis(c: Column) -> Column:
    return F.kurtosis(c)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; NULL for a constant side.

    ``corr`` throws DIVIDE_BY_ZERO under ANSI for a constant column, so the
    ratio is formed with ``try_divide``.
    """
    both = a.isNotNull() & b.isNotNull()
    aa = F.when(both, a)
    bb = F.when(both, b)
    return F.try_divide(F.covar_samp(aa, bb), F.stddev_samp(aa) * F.stddev_samp(bb))
