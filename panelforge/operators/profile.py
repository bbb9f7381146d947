"""Profiling of numeric and categorical columns.

Column-wise reports use the long layout (``variable, value``), so that one grouped aggregate serves any
number of columns; the unpivot happens before the map-side combine and is never shuffled row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.aggregates import pearson, sample_skewness, share
from panelforge.operators.cleaning import numeric_columns
from panelforge.operators.grouped import group_quantiles, group_sizes, lookup_join

QUARTILES = (0.25, 0.5, 0.75)


def long_format(df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = (), name: str = "variable") -> DataFrame:
    """``ids, variable, value`` for the given columns, by default all numeric ones."""
    columns = columns if columns is not None else numeric_columns(df, ids)
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), list(columns), name, "value")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column."""
    rows = long_format(df, columns)
    moments = rows.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = group_quantiles(rows, ["variable"], "value", QUARTILES).select(
        "variable", *[F.col("q")[i].alias(a) for i, a in enumerate(["p25", "p50", "p75"])]
    )
    return moments.join(F.broadcast(quartiles), "variable", "left")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs and distinct values per column."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    return rows.groupBy("variable").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"), F.count_distinct("value").alias("n_distinct")
    )


def zeros_and_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of zeros (a NULL is not zero), sample variance and binary / all-zero flags per column.

    A column is binary when its values are its two extremes only; testing that takes a second pass but no
    shuffle of distinct values.
    """
    rows = long_format(df, columns)
    ends = rows.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    extreme = (F.col("value") == F.col("_lo")) | (F.col("value") == F.col("_hi"))
    out = rows.join(F.broadcast(ends), "variable").groupBy("variable", "_lo", "_hi").agg(
        share(F.col("value") == 0).alias("zero_share"),
        F.var_samp("value").alias("variance"),
        F.bool_and(extreme).alias("_two"),
        F.bool_and(F.coalesce(F.col("value") == 0, F.lit(False))).alias("is_all_zero"),
    )
    binary = F.coalesce(F.col("_two") & (F.col("_lo") < F.col("_hi")), F.lit(False))
    return out.select("variable", "zero_share", "variance", binary.alias("is_binary"), "is_all_zero")


def skew_profile(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Bias-corrected skewness per column with a flag for ``abs(skew) >= threshold``."""
    rows = long_format(df, columns)
    out = rows.groupBy("variable").agg(
        sample_skewness("value").alias("skewness"), F.min("value").alias("min"),
    )
    return out.withColumn("is_skewed", F.coalesce(F.abs("skewness") >= threshold, F.lit(False)))


def log_transform_skewed(df: DataFrame, columns: Sequence[str], threshold: float = 1.0, prefix: str = "log_") -> DataFrame:
    """Replace non-negative columns with ``abs(skew) > threshold`` by their log1p."""
    stats = skew_profile(df, columns, threshold).collect()
    skewed = sorted(
        r["variable"] for r in stats
        if r["min"] is not None and r["min"] >= 0 and r["skewness"] is not None and abs(r["skewness"]) > threshold
    )
    return df.withColumns({f"{prefix}{c}": F.log1p(F.col(c)) for c in skewed}).drop(*skewed)


def correlation_by_entity(df: DataFrame, x: str, y: str, entity: str = "entity", wanted: DataFrame | None = None) -> DataFrame:
    """Correlation of two columns per entity; entities of ``wanted`` without rows get NULL."""
    out = df.groupBy(entity).agg(pearson(x, y).alias("correlation"))
    return out if wanted is None else wanted.select(entity).distinct().join(out, entity, "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All pairwise correlations over pairwise complete rows, in one pass after the column means.

    Every task reduces its Arrow batches to five k x k matrices of sums, so the plan does not grow with
    the number of pairs. NULL for a column that is constant over the pair's rows.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    k = len(columns)
    doubles = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = doubles.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(k)]).first()
    centered = doubles.select(*[(F.col(f"c{i}") - F.lit(means[i])).alias(f"c{i}") for i in range(k)])

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, k, k))
        for batch in batches:
            values = batch.to_numpy(float)
            known = np.isfinite(values)
            x, m = np.where(known, values, 0.0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"m": [total.ravel()]})

    sums = centered.mapInPandas(reduce_batches, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    sums = sums.groupBy((F.col("i") % (k * k)).alias("pair")).agg(
        *[F.sum(F.when(F.floor(F.col("i") / (k * k)) == j, F.col("v"))).alias(n) for j, n in enumerate(["n", "sx", "sy", "sxx", "sxy"])]
    ).withColumns({"row": F.floor(F.col("pair") / k).cast("int"), "col": (F.col("pair") % k).cast("int")})
    other = sums.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("sxx").alias("syy"))
    joined = sums.join(other, ["row", "col"])
    var_x, var_y = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    varies = (F.col("n") > 1) & (var_x > 1e-12 * F.col("sxx")) & (var_y > 1e-12 * F.col("syy"))
    value = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(var_x * var_y))
    names = F.array(*[F.lit(c) for c in columns])
    return joined.where("n > 0").select(
        F.get(names, F.col("row")).alias("row_var"), F.get(names, F.col("col")).alias("col_var"), value.alias("correlation")
    )


def outlier_share(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Percent of rows with ``abs(z) > threshold`` (population std) per column, only columns above zero."""
    rows = long_format(df, columns)
    stats = rows.groupBy("variable").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.abs(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")))
    out = rows.join(F.broadcast(stats), "variable").groupBy("variable").agg(
        (share(z > threshold) * 100.0).alias("outlier_pct")
    )
    return out.where(F.col("outlier_pct") > 0)


def five_numbers(df: DataFrame, value: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot summary per class: quartiles, extremes and the outermost values inside the whiskers."""
    sizes = group_sizes(df, [by])
    q = group_quantiles(df, [by], value, (0.0, 0.25, 0.5, 0.75, 1.0), sizes=sizes).select(
        by, "n", *[F.col("q")[i].alias(a) for i, a in enumerate(["min", "p25", "p50", "p75", "max"])]
    )
    fence = whisker * (F.col("p75") - F.col("p25"))
    v = F.col(value).cast("double")
    inside = (v >= F.col("p25") - fence) & (v <= F.col("p75") + fence)
    ends = lookup_join(df, q, [by], "inner").groupBy(by).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"),
    )
    return q.join(ends, by)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per category, most frequent first, ties by name."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def category_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of each category among the non-NULL values of its column, two decimals."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "category")
    counts = rows.where("category is not null").groupBy("variable", "category").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("variable").agg(F.sum("_n").alias("_t"))
    return counts.join(F.broadcast(totals), "variable").select(
        "variable", "category", F.round(100.0 * F.col("_n") / F.col("_t"), 2).alias("pct")
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column's extremes; the maximum falls into the last bin."""
    rows = long_format(df, columns).where("value is not null")
    ends = rows.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    offset = F.try_divide((F.col("value") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))
    bin_no = F.least(F.floor(F.coalesce(offset, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = rows.join(F.broadcast(ends), "variable").groupBy("variable", "_lo", "_hi", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(
        "variable", "bin", (F.col("_lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("bin_end"), "count",
    )


def within_group_std(df: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """Median over entities of the within-entity sample std, per column."""
    per_entity = df.groupBy(entity).agg(*[F.stddev_samp(c).alias(c) for c in columns])
    return group_quantiles(long_format(per_entity, columns), ["variable"], "value", [0.5]).select(
        "variable", F.col("q")[0].alias("median_within_std")
    )


def variance_inflation(matrix: np.ndarray) -> np.ndarray:
    """``1 / (1 - R2)`` of each column on the others, from their correlations; infinite when redundant."""
    factors = []
    for i in range(len(matrix)):
        others = np.delete(np.arange(len(matrix)), i)
        unexplained = 1.0 - matrix[i, others] @ np.linalg.pinv(matrix[np.ix_(others, others)], rcond=1e-10) @ matrix[others, i]
        factors.append(1.0 / unexplained if unexplained > 1e-10 else np.inf)
    return np.array(factors)


def vif_elimination(df: DataFrame, columns: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """Drop the column with the largest variance inflation factor until all are <= threshold.

    One pass gives the k x k correlation matrix; the factors follow from it, so every further step works
    on that small matrix only. Result: one row per column with the step it was
    dropped at (NULL when kept) and its factor at that point.
    """
    keep = list(columns)
    vectors = VectorAssembler(inputCols=keep, outputCol="_x", handleInvalid="skip").transform(df).select("_x")
    matrix = np.array(Correlation.corr(vectors, "_x").first()[0].toArray())
    report, step = [], 0
    while True:
        pos = [columns.index(c) for c in keep]
        factors = variance_inflation(matrix[np.ix_(pos, pos)])
        worst = int(np.argmax(factors))
        if len(keep) < 2 or factors[worst] <= threshold:
            break
        step += 1
        report.append((keep.pop(worst), step, float(factors[worst])))
    report += [(c, None, float(f)) for c, f in zip(keep, factors)]
    return df.sparkSession.createDataFrame(report, "variable string, dropped_at int, vif double")


def tied_for_most(df: DataFrame, count: str = "count") -> DataFrame:
    """Rows that share the largest count."""
    top = df.agg(F.max(count).alias(count))
    return df.join(F.broadcast(top), count, "left_semi")

