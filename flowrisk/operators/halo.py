"""Halo buckets: split each key's ordered series into fixed-size time buckets.

Window operators in Spark buffer a whole ``partitionBy`` group in one task.  Keyed by
entity alone, one hot entity (a third of all rows) would land in a single task.
Instead rows are assigned ``bucket = floor(rn / B)`` and copied into the neighbouring
buckets whose windows reach them (``lookback`` rows of history, ``lookahead`` rows of
future).  Windows are then computed per (key, bucket) and only core rows are kept.
Every group holds at most ``B + lookback + lookahead`` rows, and the copy overhead is
``(lookback + lookahead) / B``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"
CORE = "_core"


@dataclass(frozen=True)
class HaloSpec:
    """Bucket size and halo widths, in rows."""
    bucket_rows: int = 1 << 16
    lookback: int = 0
    lookahead: int = 0

    def fitted(self) -> "HaloSpec":
        """Bucket at least 4x the halo so copies stay below 25 % of the data."""
        b = max(self.bucket_rows, 4 * (self.lookback + self.lookahead), 1)
        return HaloSpec(b, self.lookback, self.lookahead)


def bucket_copies(df: DataFrame, rn: str, last_col: str, halo: HaloSpec) -> DataFrame:
    """Explode each row into every bucket whose (core + halo) range contains it.

    Bucket b holds rn in [b*B - lookback, (b+1)*B + lookahead).  ``last_col`` is the
    last ordinal of the row's series (buckets past it do not exist).
    """
    B = halo.bucket_rows
    r = F.col(rn)
    lo = F.greatest(F.floor((r - F.lit(halo.lookahead)) / F.lit(B)), F.lit(0)).cast("long")
    hi = F.least(F.floor((r + F.lit(halo.lookback)) / F.lit(B)),
                 F.floor(F.col(last_col) / F.lit(B))).cast("long")
    out = df.withColumn(BUCKET, F.explode(F.sequence(lo, hi)))
    return out.withColumn(CORE, F.floor(r / F.lit(B)) == F.col(BUCKET))
