"""Interval joins as equi joins on time buckets, so a long video is many small join keys."""
from pyspark.sql import functions as F


def _buckets(lo, hi, width):
    w = F.lit(float(width))
    return F.explode(F.sequence(F.floor(lo / w), F.greatest(F.floor(lo / w), F.floor(hi / w))))


def _bucket_column(window, lo, hi, width):
    """A point lies in one bucket and is not exploded."""
    return F.floor(lo / F.lit(float(width))) if window[0] == window[1] else _buckets(lo, hi, width)


def overlap_join(left, right, keys, l, r, width, how="inner"):
    """Pairs of rows of the same keys whose [start, end] windows touch. l and r are (start, end)
    expressions (SQL text). Columns of both sides must differ except the keys. Each pair appears once:
    it is kept only in the bucket where the later of the two starts lies. how="left" also keeps rows of left
    without a partner; such a row may repeat (once per bucket), which is for callers that aggregate."""
    a = left.withColumn("_l0", F.expr(l[0]).cast("double")).withColumn("_l1", F.expr(l[1]).cast("double"))
    b = right.withColumn("_r0", F.expr(r[0]).cast("double")).withColumn("_r1", F.expr(r[1]).cast("double"))
    a = a.withColumn("_bk", _bucket_column(l, F.col("_l0"), F.col("_l1"), width))
    b = b.withColumn("_bk", _bucket_column(r, F.col("_r0"), F.col("_r1"), width))
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bk"]]
    j = a.alias("a").join(b.alias("b"), cond + [
        F.col("_l0") <= F.col("_r1"), F.col("_r0") <= F.col("_l1"),
        F.col("a._bk") == F.floor(F.greatest("_l0", "_r0") / F.lit(float(width)))], how)
    keep = [F.col(f"a.{c}") for c in left.columns] + [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return j.select(*keep)


def no_overlap(left, right, keys, ids, l, r, width):
    """Rows of left touched by no window of right (anti form). ids identify a row of left."""
    rr = right.select(*keys, F.expr(r[0]).cast("double").alias("_ra"), F.expr(r[1]).cast("double").alias("_rb"))
    hit = overlap_join(left.select(*dict.fromkeys([*keys, *ids]), F.expr(l[0]).alias("_la"), F.expr(l[1]).alias("_lb")),
                       rr, keys, ("_la", "_lb"), ("_ra", "_rb"), width)
    return left.join(hit.select(*dict.fromkeys([*keys, *ids])).distinct(), list(dict.fromkeys([*keys, *ids])), "left_anti")
