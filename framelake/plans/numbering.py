"""Row numbers within keys whose rows may lie anywhere in the order, also all in one place."""
from pyspark.sql import Window, functions as F

from framelake.plans.similarity import written_once

#: The upper bits of monotonically_increasing_id are the partition, the lower ones the row in it.
ROW_BITS = 33


def ranged(df, keys, order):
    """df with _at, which ascends with (keys, order) over all rows. Spark deals the rows by ranges whose ends it samples, so a key
    with most rows, or one with all its rows in one day, is still many tasks; only rows equal in all of keys and order stay
    together. The ranges are written, as every later look must see the same ends."""
    by = [*keys, *order]
    return written_once(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def numbered_by_range(df, keys, order, out="n"):
    """row_number over a key (from 1): the place in its range plus the key's rows in earlier ranges. No window sees the rows
    themselves, only one count per key and range. Null keys are one key; an empty table gives none; rows equal in all of
    `order` are numbered in any order."""
    rows = ranged(df, keys, order).withColumn("_b", F.shiftright("_at", ROW_BITS))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = (rows.groupBy(*keys, "_b").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
             .withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)) + 1 - F.col("_first")).drop("_first", "_c"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    return rows.alias("l").join(start.alias("r"), same).select("l.*", "_start").withColumn(out, F.col("_at") + F.col("_start")).drop("_at", "_b", "_start")
