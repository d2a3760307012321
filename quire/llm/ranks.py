"""Running sums over a total order of any length: ranges of rows are summed where they lie, then follow one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import Scratch


def running(rows: DataFrame, within: list[str], order: str, sums: list[str], tables: Scratch, name: str) -> DataFrame:
    """rows (different in within and order) with upto_<x> for each x of sums: its sum over the rows of the same within up to this one.

    Rows are dealt out by ranges and written once with the number of their range, so that what follows sees the same
    ranges; only the sums of ranges are brought together."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables.keep(rows.repartitionByRange(ranges, *within, order).withColumn("_range", F.spark_partition_id()), name)
    before, here = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*within, "_range").orderBy(order)
    if within:
        before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*within, "_range").agg(*[F.sum(x).alias(x) for x in sums])
    ahead = totals.select(*within, "_range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in sums])
    summed = dealt.join(F.broadcast(ahead), [*within, "_range"])
    return summed.select(*rows.columns, *[(F.col(f"_{x}") + F.sum(x).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias(f"upto_{x}") for x in sums])
