"""Ordered computations that stay parallel when one key holds most of the rows.

A window over a whole library is one task. Here rows are first cut into fixed time blocks, the ordered
work is done per (key, block), and only a per-block summary is ordered over the whole key. The summary
is bounded by the time span, not by the number of rows.
"""
from pyspark.sql import Window, functions as F

HOUR = 3600


def epoch(c):
    """Seconds (double) of a wall-clock or instant column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def micros(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def block_of(c, seconds):
    return F.floor(micros(c) / F.lit(int(seconds * 1_000_000))).cast("long")


def time_islands(df, keys, ts, tie, gap_s, block_s=HOUR, out="island"):
    """Rows of a key separated by more than gap_s open a new island (strict). Returns (rows, islands):
    rows carry (_block, _part); islands maps (keys, _block, _part) to the island number."""
    gap = round(gap_s * 1_000_000)
    w = Window.partitionBy(*keys, "_block").orderBy("_us", *tie)
    rows = (df.filter(F.col(ts).isNotNull())
            .withColumn("_us", micros(ts)).withColumn("_block", block_of(ts, block_s))
            .withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(w)) > gap, F.lit(False)))
            .withColumn("_part", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_new"))
    wk = Window.partitionBy(*keys).orderBy("_lo")
    parts = (rows.groupBy(*keys, "_block", "_part").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
             .withColumn("_new", F.coalesce((F.col("_lo") - F.lag("_hi").over(wk)) > gap, F.lit(True)))
             .withColumn(out, F.sum(F.col("_new").cast("long")).over(wk.rowsBetween(Window.unboundedPreceding, 0))))
    return rows, parts.select(*keys, "_block", "_part", out)


def nearest_known(df, keys, ts, tie, value, block_s=HOUR):
    """Adds _before and _after: struct(_us, value) of the nearest rows with a known value on both sides."""
    rows = df.withColumn("_us", micros(ts)).withColumn("_block", block_of(ts, block_s))
    known = F.when(F.col(value).isNotNull() & F.col("_us").isNotNull(), F.struct("_us", *tie, F.col(value).alias("v")))
    w = Window.partitionBy(*keys, "_block").orderBy("_us", *tie)
    rows = (rows.withColumn("_k", known)
            .withColumn("_in_b", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_in_a", F.first("_k", True).over(w.rowsBetween(1, Window.unboundedFollowing))))
    wk = Window.partitionBy(*keys).orderBy("_block")
    blocks = (rows.filter("_k is not null").groupBy(*keys, "_block").agg(F.max("_k").alias("_l"), F.min("_k").alias("_f")))
    every = rows.select(*keys, "_block").distinct().join(blocks, [*keys, "_block"], "left")
    carry = (every.withColumn("_cb", F.last("_l", True).over(wk.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_ca", F.first("_f", True).over(wk.rowsBetween(1, Window.unboundedFollowing)))
             .select(*keys, "_block", "_cb", "_ca"))
    return (rows.join(carry, [*keys, "_block"], "left")
            .withColumn("_before", F.coalesce("_in_b", "_cb")).withColumn("_after", F.coalesce("_in_a", "_ca"))
            .drop("_in_b", "_in_a", "_cb", "_ca", "_k"))


def numbered(df, keys, block, order, out="n"):
    """row_number over a key, in two levels: position inside the block plus the rows of earlier blocks.
    `block` must be a prefix of the wanted order."""
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = df.withColumn("_b", block).withColumn("_n", F.row_number().over(w))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = (rows.groupBy(*keys, "_b").count()
           .withColumn("_off", F.coalesce(F.sum("count").over(wk), F.lit(0))).drop("count"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    j = rows.alias("l").join(off.alias("r"), cond)
    return j.select("l.*", "_off").withColumn(out, F.col("_n") + F.col("_off")).drop("_n", "_off", "_b")


def mid_rank(df, keys, value, width, out):
    """Rank with ties averaged, from 1. Values are counted first, then ranked per value bucket."""
    vals = (df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
            .withColumn("_b", F.floor(F.col(value) / F.lit(float(width)))))
    w = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    vals = vals.withColumn("_in", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = (vals.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
           .withColumn("_off", F.coalesce(F.sum("_t").over(wk), F.lit(0))).drop("_t"))
    ranks = (vals.join(off, [*keys, "_b"])
             .withColumn(out, F.col("_off") + F.col("_in") + (F.col("_c") + 1) / F.lit(2.0))
             .select(*keys, value, out))
    return df.join(ranks, [*keys, value])
