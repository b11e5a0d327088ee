"""Running totals and numbers over an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut, keep


def running(rows: DataFrame, order: list[Column], value: Column, to: str = "before", number: str | None = None) -> DataFrame:
    """Add the sum of a value over all earlier rows, and if wanted the row's number from 0.

    Rows are range-partitioned by the order, summed by partition, and summed again
    inside each; only one total for each partition is on the driver. The order must be total.
    """
    placed = cut(rows.withColumn("_v", value.cast("double")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = sorted((r["_p"], r["s"], r["n"]) for r in placed.groupBy("_p").agg(F.sum("_v").alias("s"), F.count("*").alias("n")).collect())
    sums, counts, s, n = {}, {}, 0.0, 0
    for p, total, count in totals:
        sums[p], counts[p] = s, n
        s, n = s + (total or 0.0), n + count
    if not totals:
        out = placed.withColumn(to, F.lit(0.0))
        return (out.withColumn(number, F.lit(0)) if number else out).drop("_v", "_p")
    start = F.create_map(*[F.lit(x) for pair in sums.items() for x in pair])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn(to, start[F.col("_p")] + F.coalesce(F.sum("_v").over(own), F.lit(0.0)))
    if number:
        first = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        out = out.withColumn(number, first[F.col("_p")] + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return out.drop("_v", "_p")


def numbered(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """Add the row's number from 0 in a total order.

    Like running() without a sum, but rows are moved once and written as a table of
    columns: in a sorted partition a row's place is its number, and only one count for
    each partition is on the driver.
    """
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    starts, n = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(r.p), F.lit(n)]
        n += r.n
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    return placed.withColumn(to, (start + place).cast("long")).drop("_at")


def last_known(rows: DataFrame, group: str, order: str, value: Column, to: str) -> DataFrame:
    """Add the last value that isn't null up to each row of its group, in order.

    Rows are range-partitioned by group and order, so a group may go over many
    partitions; what one hands to the next is one value, and only those are on the driver.
    """
    placed = cut(rows.withColumn("_v", value).repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()))
    place = F.struct(group, order)
    ends = {r["_p"]: r for r in placed.groupBy("_p").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(F.struct(F.col(group).alias("g"), F.col("_v").alias("v")), F.when(F.col("_v").isNotNull(), place)).alias("told")).collect()}
    carried, now = {}, None
    for p in sorted(ends):
        r = ends[p]
        if now is not None and r["first"] == now[0]:
            carried[p] = now
        if r["told"] is not None and r["told"]["g"] == r["last"]:
            now = (r["last"], r["told"]["v"])
        elif now is not None and now[0] != r["last"]:
            now = None
    own = Window.partitionBy("_p", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn(to, F.last("_v", ignorenulls=True).over(own))
    if carried:
        before = F.create_map(*[F.lit(x) for p, (_, v) in carried.items() for x in (p, v)])
        whose = F.create_map(*[F.lit(x) for p, (g, _) in carried.items() for x in (p, g)])
        out = out.withColumn(to, F.coalesce(to, F.when(whose[F.col("_p")] == F.col(group), before[F.col("_p")])))
    return out.drop("_v", "_p")
