"""Null-safe scalar expressions.

Missing values are NULL inside the engine, never NaN: Spark orders NaN above every number, so a NaN
would count as "greater than the cap" where it must count as "unknown".
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_64 = 18446744073709551616.0
SIGNED_LOG_PREFIX = "x_log_signed_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: Column | str, finite: bool = False) -> Column:
    """Coerce to double; text that is no number and NaN become NULL, with ``finite`` also +-infinity."""
    d = col(c).try_cast("double")
    keep = ~F.isnan(d)
    if finite:
        keep = keep & (F.abs(d) < F.lit(float("inf")))
    return F.when(keep, d)


def clip(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; NULL stays NULL although ``greatest``/``least`` skip NULL arguments."""
    x = col(c)
    y = x
    if lower is not None:
        y = F.greatest(y, F.lit(float(lower)))
    if upper is not None:
        y = F.least(y, F.lit(float(upper)))
    return F.when(x.isNotNull(), y)


def signed_log1p(c: Column | str) -> Column:
    x = col(c)
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(c: Column | str) -> Column:
    """Inverse of :func:`signed_log1p`, with the exponent bounded at +-700."""
    z = clip(c, -700.0, 700.0)
    return F.signum(z) * F.expm1(F.abs(z))


def pct_change(start: Column | str, end: Column | str) -> Column:
    """Change in percent of ``abs(start)``; NULL when the start is zero."""
    s, e = col(start), col(end)
    return F.try_divide(e - s, F.abs(s)) * 100.0


def stable_unit(*parts: Column | str | int) -> Column:
    """Reproducible number in [0, 1): the first 64 bits of SHA-256 over the parts joined by a bar.

    The value depends only on the key, so it is the same on every run, partitioning and retry.
    Strings name columns; pass ``F.lit`` for constants.
    """
    text = F.concat_ws("|", *[col(p).cast("string") if not isinstance(p, int) else F.lit(str(p)) for p in parts])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(TWO_POW_64)


def standard_normal(*parts: Column | str | int) -> Column:
    """Reproducible N(0, 1) draw by Box-Muller on two stable uniforms."""
    u1 = F.greatest(stable_unit(*parts, F.lit("a")), F.lit(1.0 / TWO_POW_64))
    u2 = stable_unit(*parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def isclose(a: Column | str, b: Column | str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def compare_close(value: Column | str, reference: Column | str) -> Column:
    """'equal' within tolerance, else 'above' or 'below'; NULL when either side is missing."""
    v, r = col(value), col(reference)
    return (
        F.when(v.isNull() | r.isNull(), F.lit(None).cast("string"))
        .when(isclose(v, r), "equal")
        .when(v > r, "above")
        .otherwise("below")
    )


def parse_list(c: Column | str) -> Column:
    """Split a bar-separated list, dropping empty items."""
    return F.filter(F.split(col(c), r"\|"), lambda x: x != "")


def standard_name(c: Column | str) -> Column:
    """``name__stat`` -> ``name``."""
    return F.substring_index(col(c), "__", 1)


def ordered_union(a: Column | str, b: Column | str) -> Column:
    """Union of two lists keeping first appearances in order."""
    return F.array_distinct(F.concat(col(a), col(b)))


def slugify(label: str) -> str:
    """Label -> column name: lower case, runs of other characters become one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", label.strip().lower()).strip("_")

