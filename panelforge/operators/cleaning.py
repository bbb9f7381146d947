"""Projection, selection and cleaning of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.scalar import clean_number
from panelforge.operators.grouped import keep_first


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def drop_groups(df: DataFrame, groups: dict[str, list[str]], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns of the named variable groups; unknown columns are ignored."""
    return df.drop(*[c for g in names for c in groups[g] if c not in keep])


def clean_numbers(df: DataFrame, columns: Sequence[str], finite: bool = False) -> DataFrame:
    return df.withColumns({c: clean_number(c, finite) for c in columns})


def drop_missing(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    """``any``: drop rows with a NULL in the subset; ``all``: drop rows where the whole subset is NULL."""
    return df.na.drop(how=how, subset=list(subset))


def all_zero_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column, whether every value is zero (a NULL is not zero)."""
    return df.agg(*[F.bool_and(F.coalesce(F.col(c) == 0, F.lit(False))).alias(c) for c in columns])


def drop_all_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flags = all_zero_flags(df, columns).first()
    return df.drop(*[c for c in columns if flags[c]])


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def select_entities(df: DataFrame, requested: Sequence[str] | None, entity: str = "entity") -> DataFrame:
    """Rows of the requested entities, matched without regard to case; None keeps all.

    Raises when a requested entity does not occur.
    """
    if requested is None:
        return df
    names = sorted({str(r).strip().upper() for r in requested})
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "_want string")
    present = df.select(F.upper(entity).alias("_want")).distinct()
    missing = [r["_want"] for r in missing_keys(wanted, present, "_want").orderBy("_want").collect()]  # of the caller's own list
    if missing:
        raise ValueError(f"the table has no rows of {missing}")
    return df.join(F.broadcast(wanted), F.upper(F.col(entity)) == F.col("_want"), "left_semi")


def missing_keys(reference: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of the reference list that the data lacks."""
    return reference.select(key).distinct().join(present.select(key), key, "left_anti")


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = False, sep: str = "_") -> DataFrame:
    """Replace categorical columns by 0/1 indicator columns, one per level in ascending order.

    The result has a column per level, so this is for columns whose levels can be columns; :func:`one_hot_vector` holds
    any number of levels in one sparse vector.
    """
    out = df
    for c in columns:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()][1 if drop_first else 0:]
        out = out.withColumns({
            f"{c}{sep}{level}": F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0)) for level in levels
        })
    return out.drop(*columns)


def one_hot_vector(df: DataFrame, columns: Sequence[str], output: str = "features", drop_first: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """Categorical columns as one sparse vector ``output`` in their place, and the levels of each column in vector order.

    Works for any number of levels. Levels ascend; a NULL has no entry, nor, with ``drop_first``, has the first level.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    levels, vectors, out = {}, [], df
    for c in columns:
        known = df.where(F.col(c).isNotNull())
        first = known.agg(F.min(c)).first()[0] if drop_first else None
        index = StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep")
        index = index.fit(known.where(F.col(c) != first) if drop_first else known)
        levels[c] = list(index.labels)
        # Unknown levels (NULL, the first one) take the last index, which the encoder drops.
        out = index.transform(out)
        out = OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_v_{c}", dropLast=True).fit(out).transform(out) if levels[c] else out
        vectors += [f"_v_{c}"] if levels[c] else []
    out = VectorAssembler(inputCols=vectors, outputCol=output).transform(out)
    return out.drop(*columns, *[f"_i_{c}" for c in columns], *vectors), levels


def reference_dimension(
    df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] | None, upper: bool = True
) -> DataFrame:
    """Prepare a caps or income table: required columns, upper-cased key, one row per key.

    Of several rows the first by ``order`` counts, whatever its values. Without ``order`` keys must be unique as they are.
    """
    require_columns(df, [key, *columns])
    rows = df.select(key, *columns, *[F.col(o).alias(f"_order_{i}") for i, o in enumerate(order or [])]).where(F.col(key).isNotNull())
    if upper:
        rows = rows.withColumn(key, F.upper(F.trim(F.col(key).cast("string"))))
    if order:
        rows = keep_first(rows, [key], [f"_order_{i}" for i in range(len(order))])
    return rows.select(key, *columns)


