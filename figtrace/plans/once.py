"""Computing derived columns once, however often they are used afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same frame, with a boundary below which the named columns are not substituted.

    Catalyst writes a filter or key over a derived column in terms of what that column was derived
    from. For columns resting on several layers of conditions this repeats every layer below for
    every mention, without end in sight. A one-element unnest is a place where that stops; filters on
    all other columns still pass it on their way to the scan. The named columns go together: give only
    those that will be used.
    """
    kept = [c for c in df.columns if c not in names]
    bundle = F.array(F.struct(*[F.col(n) for n in names]))
    return df.select(*kept, F.explode(bundle).alias("_once")).select(
        *[f"_once.{c}" if c in names else c for c in df.columns]
    )
