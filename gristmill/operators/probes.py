"""What probes of a source show: fill rates, and runs that fall behind the first that worked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.numeric import share

DROP, SHORTFALL = 0.8, 0.5


def degradation(log: DataFrame, drop: float = DROP) -> DataFrame:
    """Adds first_count, what the first successful run of the probe so far returned, and whether this run fell below
    `drop` of it. A probe is a handful of runs, so a window for each is bounded. (A30, W8)"""
    so_far = Window.partitionBy("probe").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("status") == "success", F.col("returned")), ignorenulls=True).over(so_far)
    rows = log.withColumn("first_count", first)
    return rows.withColumn("throttled", F.coalesce((F.col("first_count") > 0) & (F.col("returned") < F.col("first_count") * F.lit(drop)), F.lit(False)))


def fill_rate(log: DataFrame, shortfall: float = SHORTFALL) -> DataFrame:
    """Percent of what was asked for that came, for runs that worked, and a flag under `shortfall`."""
    ok = (F.col("status") == "success") & (F.col("requested") > 0)
    rate = F.when(ok, share(F.lit(100) * F.col("returned"), F.col("requested")))
    return log.withColumn("fill_pct", rate).withColumn("short", (F.col("status") == "success") & (F.col("returned") < F.col("requested") * F.lit(shortfall)))


def delay_pairs(pairs: DataFrame, drop: float = DROP) -> DataFrame:
    """Two fetches with a delay between them: (delay, first_status, first_returned, second_returned) with a flag. (O3)"""
    bad = (F.col("first_status") == "success") & (F.col("second_returned") < F.col("first_returned") * F.lit(drop))
    return pairs.withColumn("degraded", F.coalesce(bad, F.lit(False)))
