"""As-of join: each row with the latest row of the other side, of its key and not after its time.

Both sides are put together and dealt by ranges of (key, time), so a key that holds a third of all rows spreads over as many
tasks as its rows need. Inside a range the last row of the other side is carried forward; what a range carries over its end
to the next ones of the same key are at most two rows a range, and only rows before the first match of a range's first
key look there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str | None = None, strict: bool = False, tolerance: Column | None = None, suffix: str = "_right") -> DataFrame:
    """Every row of ``left`` with the columns of its match in ``right``, null without one.

    ``by`` is the key and ``on`` the time of both sides (``right_on`` that of ``right``, if named otherwise). ``strict`` asks for an earlier
    time, not an equal one; ``tolerance`` is the longest distance of a match, in the unit of ``left.on - right.on``. Of several rows
    of ``right`` with one key and time the greatest by its columns in order counts. Rows with a null key or time match nothing.
    Columns of ``right`` but the key get ``suffix`` where ``left`` has the name.
    """
    right_on = right_on or on
    others = [c for c in right.columns if c != by]
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    # Of one key and time a left row comes after the right ones, or before them if an equal time doesn't count.
    a = left.filter(known).select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__left"))
    b = right.filter(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(
        F.col(by).alias("__by"), F.col(right_on).alias("__on"), F.lit(1 if strict else 0).alias("__side"), F.struct(*others).alias("__right")
    )
    rows = a.unionByName(b, allowMissingColumns=True)
    order = ["__by", "__on", "__side"]
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows alike in all three (a hot moment) are split by their content.
    tied = rows.withColumn("__tie", F.when(F.col("__right").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("__left")))
    ranged = scratch.written(tied.repartitionByRange(parts, *order, "__tie").withColumn("__part", F.spark_partition_id()), "ranged")

    inside = Window.partitionBy("__part", "__by").orderBy("__on", "__side", "__right")
    filled = ranged.withColumn("__match", F.last("__right", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ranged.groupBy("__part").agg(F.min("__by").alias("first"), F.max("__by").alias("last"))
    last = ranged.filter(F.col("__right").isNotNull()).groupBy("__part", "__by").agg(F.max(F.struct("__on", "__right"))["__right"].alias("__right"))
    # Two rows a range: its first key asks, then its last key tells what it ends with.
    asks = ends.select("__part", F.col("first").alias("__by"), F.lit(0).alias("step"), F.lit(None).cast(last.schema["__right"].dataType).alias("__right"))
    tells = ends.select("__part", F.col("last").alias("__by")).join(last, ["__part", "__by"]).select("__part", "__by", F.lit(1).alias("step"), "__right")
    earlier = Window.partitionBy("__by").orderBy("__part", "step").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(tells).withColumn("__carried", F.last("__right", ignorenulls=True).over(earlier)).filter("step = 0").select("__part", "__by", "__carried")
    matched = filled.filter(F.col("__left").isNotNull()).join(F.broadcast(carried), ["__part", "__by"], "left")  # one row a range
    matched = matched.select("__left", F.coalesce("__match", "__carried").alias("__match")).unionByName(
        left.filter(~F.coalesce(known, F.lit(False))).select(F.struct(*left.columns).alias("__left"), F.lit(None).cast(last.schema["__right"].dataType).alias("__match"))
    )
    if tolerance is not None:
        far = F.col("__left")[on] - F.col("__match")[right_on] > tolerance
        matched = matched.withColumn("__match", F.when(~F.coalesce(far, F.lit(True)), F.col("__match")))
    taken = {c.lower() for c in left.columns}
    return matched.select("__left.*", *(F.col("__match")[c].alias(c + suffix if c.lower() in taken else c) for c in others))
