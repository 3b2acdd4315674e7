"""Column-expression helpers shared by all operators (JVM side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Column by name; names may contain dots (quoted), Columns pass through."""
    if isinstance(c, str):
        return F.col(c if c.startswith("`") else f"`{c}`")
    return c


def nan_to_null(c) -> Column:
    """pandas NaN semantics -> SQL NULL (Spark evaluates ``NaN > 0.7`` as true)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def safe_div(a, b) -> Column:
    """Division that yields NULL on a zero denominator instead of raising (ANSI)."""
    return F.try_divide(col(a), col(b))


def clip(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip to [lo, hi]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def falsey(cond: Column) -> Column:
    """A comparison that pandas resolves to False on NaN/NULL: NULL -> False."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 integer, NULL counts as 0 (``(s > x).astype(int)``)."""
    return F.when(falsey(cond), F.lit(1)).otherwise(F.lit(0))


def canonical_id(c) -> Column:
    """Trimmed string id without a trailing ``.0`` (float ids such as 31144.0)."""
    s = F.trim(col(c).cast("string"))
    return F.regexp_replace(s, r"\.0+$", "")


def rnd(c, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)


def complete(cols) -> Column:
    """P6 predicate: every column non-null.

    Written as one null-count expression instead of a conjunction of ``IS NOT NULL``
    terms: over wide window-derived projections the per-column constraints make
    Catalyst's constraint propagation grow without bound.
    """
    n = F.lit(0)
    for c in cols:
        n = n + col(c).isNull().cast("int")
    return n == F.lit(0)


def attach_scalars(df, one_row):
    """Attach the columns of a one-row frame to every row (broadcast equi-join on a
    constant key; the right side is a single aggregate row, so its size is fixed)."""
    k = "__scalar_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k) \
             .drop(k)
