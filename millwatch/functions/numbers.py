"""Row-wise expressions over many columns: nulls are skipped, NaN counts as null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c) -> Column:
    """The column as double with NaN as null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def to_number(c, default: float) -> Column:
    """A number from anything, the default where it is none."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(float(default)))


def _either(f, cols: list[str]) -> Column:
    """f (least or greatest, which skip nulls) over the columns' values."""
    return f(*[clean(c) for c in cols]) if len(cols) > 1 else clean(cols[0]) if cols else F.lit(None).cast("double")


def count_of(cols: list[str]) -> Column:
    """How many of the columns have a value."""
    return add([F.lit(0), *[clean(c).isNotNull().cast("int") for c in cols]])


def mean_of(cols: list[str]) -> Column:
    return F.try_divide(add([F.lit(0.0), *[F.coalesce(clean(c), F.lit(0.0)) for c in cols]]), count_of(cols))


def std_of(cols: list[str], mean: Column | None = None) -> Column:
    """Sample standard deviation; null for fewer than two values. The mean is made once a row, as a list's one element, or
    is a column that the caller has made, which Spark compiles."""
    square = lambda c, m: F.coalesce((clean(c) - m) * (clean(c) - m), F.lit(0.0))
    if mean is not None:
        return F.when(count_of(cols) > 1, F.sqrt(add([F.lit(0.0), *[square(c, mean) for c in cols]]) / (count_of(cols) - 1)))
    squares = F.get(F.transform(F.array(mean_of(cols)), lambda m: add([F.lit(0.0), *[square(c, m) for c in cols]])), 0)
    return F.when(count_of(cols) > 1, F.sqrt(squares / (count_of(cols) - 1)))


def min_of(cols: list[str]) -> Column:
    return _either(F.least, cols)


def max_of(cols: list[str]) -> Column:
    return _either(F.greatest, cols)


def null_share(cols: list[str]) -> Column:
    return 1 - count_of(cols) / float(len(cols))


def any_of(cols: list[str]) -> Column:
    """1 where some column has a value."""
    return F.coalesce(*[clean(c) for c in cols]).isNotNull().cast("int") if cols else F.lit(0)


def add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)
