"""Exact quantiles per key without holding a key's values in one task.

The values are written; a key's interval is narrowed by histograms of that table until few of them are left in it, and only those
are ordered. What a task sends is a row for each key and bin, not its values. Keys that all have few values are ordered at once.
Nothing depends on how a key's values are spread.
"""
from pyspark.sql import Window, functions as F

from framelake.plans.similarity import SMALL_ROWS, written_once

#: Bins of one narrowing step, and values of a key that one task orders.
BINS, FEW = 256, 20_000


def _ranks(p, kind):
    """The two ranks whose values decide, from 0."""
    if kind == "upper":
        return F.floor(F.col("_n") / 2), F.floor(F.col("_n") / 2)
    at = F.lit(float(p)) * (F.col("_n") - 1)
    return F.floor(at), F.ceil(at)


def _narrowed(values, span, keys):
    """Each key's interval cut down to the bin that holds its two ranks. Where they lie in two bins, they are neighbours: the largest
    value of the one and the smallest of the other, and nothing is left to search."""
    inside = values.join(span, list(keys)).filter("_v BETWEEN _lo AND _hi")
    bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") / 2 - F.col("_lo") / 2).otherwise(1.0) * BINS))
    held = [*keys, "_n", "_r0", "_r1", "_before"]
    bins = inside.groupBy(*held, bin_.alias("_b")).agg(F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)       # at most BINS rows a key
    bins = bins.withColumn("_end", F.col("_before") + F.sum("_d").over(w)).withColumn("_start", F.col("_end") - F.col("_d"))
    return _settled(bins.filter((F.col("_end") > F.col("_r0")) & (F.col("_start") <= F.col("_r1"))).groupBy(*keys, "_n", "_r0", "_r1")
                    .agg(F.min("_start").alias("_before"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_d").alias("_d"),
                         F.when(F.count("*") > 1, F.min("_hi")).alias("_a"), F.when(F.count("*") > 1, F.max("_lo")).alias("_b")))


def _settled(span):
    """One value in the interval is both."""
    same = F.col("_lo") == F.col("_hi")
    return span.withColumn("_a", F.when(same, F.col("_lo")).otherwise(F.col("_a"))).withColumn("_b", F.when(same, F.col("_lo")).otherwise(F.col("_b")))


def exact_quantile(df, keys, value, p=0.5, kind="linear", out="q", n=None):
    """kind: linear (interpolated; p=.5 is the usual median) or upper (sorted[n // 2], only p=.5).
    n names a column for the number of values."""
    one = not keys
    if one:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    keys = list(keys)
    values = written_once(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    r0, r1 = _ranks(p, kind)
    none = F.lit(None).cast("double")
    span = _settled(values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_d"))
                    .withColumn("_r0", r0).withColumn("_r1", r1).withColumn("_before", F.lit(0).cast("long")).withColumn("_a", none).withColumn("_b", none))
    most = lambda: span.agg(F.max(F.when(F.col("_a").isNull(), F.col("_d"))), F.max("_d"), F.count("*")).first()
    left, all_, rows = most()
    at = lambda r: F.get("_s", (F.col(r) - F.col("_before")).cast("int"))
    ordered = F.sort_array(F.collect_list("_v")).alias("_s")                    # at most FEW
    if (all_ or 0) <= FEW:                                                      # no key needs its span
        few = values.groupBy(*keys).agg(ordered).withColumn("_before", F.lit(0)).withColumn("_n", F.size("_s").cast("long")).withColumn("_r0", r0).withColumn("_r1", r1)
        return _valued(few.withColumn("_a", at("_r0")).withColumn("_b", at("_r1")), keys, one, p, kind, out, n)
    small = rows <= SMALL_ROWS
    side = lambda s: F.broadcast(s) if small else s  # noqa: E731  a row of ten numbers a key
    span = written_once(span)
    done = []
    while (left or 0) > FEW:
        done.append(span.filter("_a IS NOT NULL"))
        span = written_once(_narrowed(values, side(span.filter("_a IS NULL").drop("_a", "_b", "_d")), keys))
        left, _, _ = most()
    held = [*keys, "_n", "_r0", "_r1", "_before"]
    rest = values.join(side(span.filter("_a IS NULL").select(*held, "_lo", "_hi")), keys).filter("_v BETWEEN _lo AND _hi").groupBy(*held).agg(ordered)
    res = rest.select(*keys, "_n", "_r0", at("_r0").alias("_a"), at("_r1").alias("_b"))
    for d in [*done, span.filter("_a IS NOT NULL")]:
        res = res.unionAll(d.select(*res.columns))
    return _valued(res, keys, one, p, kind, out, n)


def _valued(res, keys, one, p, kind, out, n):
    frac = F.lit(float(p)) * (F.col("_n") - 1) - F.col("_r0") if kind != "upper" else F.lit(0.0)
    res = res.withColumn(out, F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    return res.select(*([] if one else keys), out, *([F.col("_n").alias(n)] if n else []))
