"""Station totals and exact-count overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.operators.counts import COUNT


def station_totals(counts: DataFrame, station_col: str = "station_name", count_col: str = COUNT) -> DataFrame:
    """Sum of counts per station; rows without a station are dropped.

    The input is already aggregated (one row per station and label), so this is
    a small aggregation with map-side partial sums.
    """
    return (
        counts.where(F.col(station_col).isNotNull())
        .groupBy(station_col)
        .agg(F.sum(count_col).cast("long").alias(count_col))
        .select(station_col, count_col)
    )


def override_totals(totals: DataFrame, exact: DataFrame, station_col: str = "station_name", count_col: str = COUNT) -> DataFrame:
    """Replace a station's summed total by its exact count where one is given.

    Stations missing from ``exact`` keep their sum; stations only in ``exact``
    add no row. A missing total becomes 0.
    """
    exact_side = exact.select(station_col, F.col(count_col).alias("_exact"))
    joined = totals.join(exact_side, station_col, "left")
    return joined.select(station_col, F.coalesce(F.col("_exact"), F.col(count_col), F.lit(0)).cast("long").alias(count_col))
