"""Aggregate expressions that stay defined on constant or short groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.scalar import col


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are present; NULL when either side is constant.

    ``corr`` raises a division error on constant input under ANSI mode, hence the explicit guard.
    """
    a = F.when(col(y).isNotNull(), col(x).cast("double"))
    b = F.when(col(x).isNotNull(), col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def sample_skewness(x: Column | str) -> Column:
    """Bias-corrected skewness; zero for a constant column and NULL below three values."""
    c = col(x).cast("double")
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(F.min(c) < F.max(c), corrected).otherwise(0.0))


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; an unknown condition counts as not holding."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))
