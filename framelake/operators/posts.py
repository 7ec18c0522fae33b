"""Published posts: features, baselines, weights and rubric calibration."""
from pyspark.sql import Window, functions as F

from framelake.functions.core import c, let, py_round
from framelake.plans.ordered import mid_rank, numbered
from framelake.plans.quantile import exact_quantile
from framelake.plans.similarity import small_side, written_once

# Duration bands, metric weights, weight limits, rubric criteria and their weights.
BANDS = ((0, 12, "under 12s"), (12, 20, "12-20s"), (20, 30, "20-30s"), (30, 45, "30-45s"), (45, 60, "45-60s"), (60, 10 ** 9, "over 60s"))
METRIC_WEIGHTS = {"views": 1.0, "saves_rate": 2.0, "watch_pct": 2.0, "shares_rate": 1.5, "followers_rate": 1.5, "comments_rate": 1.0, "likes_rate": 0.5}
WEIGHT_MIN, WEIGHT_MAX = 0.7, 1.35
RUBRIC = {"A1": 8, "A2": 9, "A3": 8, "B1": 6, "B2": 7, "B3": 7, "C1": 9, "C2": 8, "C3": 8, "D1": 5, "D2": 5, "D3": 5, "E1": 5, "E2": 5, "F1": 3, "F2": 2}
RUBRIC_FLOOR, KEY_FLOOR, KEY_CRITERIA = 65, 5, ("A2", "A3", "C1")


def duration_band(s):
    return F.coalesce(*[F.when((c(s) >= lo) & (c(s) < hi), label) for lo, hi, label in BANDS])


def retention_curve(text):
    """'0:100, 2:64%' as sorted (t, pct) points; null when any pair does not read."""
    pair = r"^\s*(\d+(?:\.\d+)?)\s*:\s*(\d+(?:\.\d+)?)\s*%?\s*$"
    parts = F.split(c(text), ",")
    ok = F.forall(parts, lambda x: x.rlike(pair))
    pts = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, pair, 1).try_cast("double").alias("t"), F.regexp_extract(x, pair, 2).try_cast("double").alias("pct")))
    return F.when(ok, F.array_sort(pts))


def rates(posts):
    """Rates per view; absolute numbers of accounts of different size do not compare."""
    v = F.when(F.coalesce("views", F.lit(0)) > 0, F.col("views").cast("double"))
    out = posts.withColumn("_v", v)
    for m in ("saves", "likes", "comments", "shares", "followers"):
        out = out.withColumn(f"{m}_rate", F.col(m) / F.col("_v"))
    return out.withColumn("views", F.col("_v")).drop("_v")


def post_features(posts):
    return (rates(posts).withColumn("band", duration_band("duration_s")).withColumn("curve", retention_curve("retention_text"))
            .withColumn("curve_ok", F.when(F.col("retention_text").isNotNull(), F.col("curve").isNotNull())))


def kept_at(curve, t):
    """Share still watching at second t, linear between points; null before the first one."""
    def at(cv):
        n = F.size(cv)
        segs = F.arrays_zip(F.slice(cv, F.lit(1), n - 1).alias("a"), F.slice(cv, F.lit(2), n - 1).alias("b"))
        hit = F.get(F.filter(segs, lambda s: (s["a"]["t"] <= t) & (F.lit(t) <= s["b"]["t"])), F.lit(0))
        last = F.get(cv, n - 1)

        def inside(h):
            span = h["b"]["t"] - h["a"]["t"]
            return h["a"]["pct"] + (h["b"]["pct"] - h["a"]["pct"]) * (t - h["a"]["t"]) / F.when(span == 0, 1.0).otherwise(span)
        return F.when(n > 0, F.coalesce(let(hit, inside), F.when(last["t"] < t, last["pct"])))
    return let(curve, at)


def baseline(posts, g=("platform",)):
    """Middle value of each rate."""
    long = (rates(posts).withColumn("_m", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRIC_WEIGHTS])))
            .select(*g, "_m.metric", "_m.value").filter("value is not null"))
    return exact_quantile(long, [*g, "metric"], "value", out="base")


def score_posts(posts, g=("platform",), base=None):
    """Weighted mean of clipped ratios to the baseline. The baseline has one small row per group, is written once and, its
    size checked, sent to the posts, which stay where they are; pass one (from history) to score arriving posts."""
    base = written_once((baseline(posts, g) if base is None else base).groupBy(*g).agg(*[F.max(F.when(F.col("metric") == m, F.col("base"))).alias(f"_b_{m}") for m in METRIC_WEIGHTS]))
    total, used = F.lit(0.0), F.lit(0.0)
    for m, w in METRIC_WEIGHTS.items():
        b = F.col(f"_b_{m}")
        on = b.isNotNull() & (b != 0) & F.col(m).isNotNull()
        total = total + F.when(on, w * F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.col(m) / b))).otherwise(0.0)
        used = used + F.when(on, w).otherwise(0.0)
    return (rates(posts).join(small_side(base), list(g), "left").withColumn("_u", used)
            .withColumn("score", F.when(F.col("_u") > 0, total / F.col("_u"))).drop("_u", *[f"_b_{m}" for m in METRIC_WEIGHTS]))


def group_weights(scored, g=("platform",), axes=("format", "hook", "close", "voice", "length")):
    """Weight per value of each axis (length: the band of the duration); few posts are pulled back towards neutral."""
    pick = [F.struct(F.lit(a).alias("axis"), (duration_band("duration_s") if a == "length" else F.col(a).cast("string")).alias("name")) for a in axes]
    long = (scored.filter("score is not null").withColumn("_a", F.explode(F.array(*pick)))
            .select(*g, "_a.axis", "_a.name", "score").filter("name is not null and name <> ''"))
    k = [*g, "axis", "name"]
    r = exact_quantile(long, k, "score", out="raw", n="n")
    damp = F.when(F.col("n") < 2, 0.35).when(F.col("n") < 4, 0.7).otherwise(1.0)
    return r.select(*k, "n", py_round("raw", 2).alias("score"),
                    py_round(F.greatest(F.lit(WEIGHT_MIN), F.least(F.lit(WEIGHT_MAX), 1.0 + (F.col("raw") - 1.0) * damp)), 2).alias("weight"),
                    F.when(F.col("n") < 2, "anecdote").when(F.col("n") < 4, "low").otherwise("usable").alias("confidence"))


def weights_to_changes(weights, g=("platform",)):
    """Formats with evidence become list changes: worked from 1.15 up, failed from 0.85 down."""
    leaf = F.when(F.col("weight") >= 1.15, "worked").when(F.col("weight") <= 0.85, "failed")
    return (weights.filter("axis = 'format' and confidence <> 'anecdote'").withColumn("leaf", leaf).filter("leaf is not null")
            .select(*g, F.lit("formats").alias("section"), "leaf", F.col("name").alias("value")))


def untried(scored, g=("platform",)):
    seen = (scored.filter("score is not null").withColumn("band", duration_band("duration_s")).filter("band is not null")
            .groupBy(*g).agg(F.collect_set("band").alias("_s")))
    return seen.select(*g, F.explode(F.array_except(F.array(*[F.lit(b[2]) for b in BANDS]), F.col("_s"))).alias("band"))


def rubric_total(scores, key="post_id"):
    """Weighted total out of 100 (missing criteria count 0) and whether it blocks delivery."""
    w = F.coalesce(*[F.when(F.col("criterion") == k, v) for k, v in RUBRIC.items()], F.lit(0))
    low = F.count_if(F.col("criterion").isin(*KEY_CRITERIA) & (F.col("score") < KEY_FLOOR))
    return (scores.groupBy(key).agg(F.sum(w * F.col("score")).alias("_p"), low.alias("low_key"))
            .withColumn("total", F.bround(F.col("_p") / 10.0, 0).cast("long"))
            .withColumn("blocks", (F.col("total") < RUBRIC_FLOOR) | (F.col("low_key") > 0)).drop("_p"))


def _outcomes(posts, scores, g):
    curve = retention_curve("retention_text")
    y = F.coalesce(F.col("watch_pct"), F.when((F.col("avg_watch_s") != 0) & (F.col("duration_s") != 0), 100.0 * F.col("avg_watch_s") / F.col("duration_s")), kept_at(curve, 3.0))
    wide = scores.groupBy(F.col("post_id").alias("id")).pivot("criterion", list(RUBRIC)).agg(F.max("score"))
    return (posts.join(wide, "id").withColumn("y", y.cast("double")).withColumn("curve", curve).filter("y is not null"))


def calibrate(posts, scores, min_n=3, g=("platform",)):
    """Spearman of each criterion and of the total against the share watched. Posts are ranked by that share once; per value
    of a criterion only a count and sums of those ranks remain, from which its own ranks and the covariance follow."""
    rows = _outcomes(posts, scores, g)
    total = sum((F.coalesce(F.col(k), F.lit(0)) * w for k, w in RUBRIC.items()), F.lit(0))
    xs = [F.struct(F.lit(k).alias("criterion"), F.coalesce(F.col(k), F.lit(0)).cast("double").alias("x")) for k in RUBRIC]
    xs.append(F.struct(F.lit("total").alias("criterion"), F.bround(total / 10.0, 0).alias("x")))
    rows = written_once(rows.select(*g, "id", "y", F.array(*xs).alias("xs")))
    ranked = mid_rank(rows, list(g), "y", 0.25, "ry")
    cells = (ranked.select(*g, "ry", F.explode("xs").alias("_x")).groupBy(*g, "_x.criterion", "_x.x")
             .agg(F.count("*").alias("c"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy")))
    w = Window.partitionBy(*g, "criterion").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)      # values of a criterion: few
    rx = F.sum("c").over(w) - F.col("c") + (F.col("c") + 1) / 2.0
    a = cells.withColumn("rx", rx).groupBy(*g, "criterion").agg(
        F.sum("c").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum(F.col("rx") * F.col("c")).alias("sx"),
        F.sum(F.col("rx") * F.col("rx") * F.col("c")).alias("sxx"), F.sum(F.col("rx") * F.col("sy")).alias("sxy"))
    n = F.col("n")
    vx, vy, cov = F.col("sxx") * n - F.col("sx") * F.col("sx"), F.col("syy") * n - F.col("sy") * F.col("sy"), F.col("sxy") * n - F.col("sx") * F.col("sy")
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy))).otherwise(0.0)
    return a.filter(n >= min_n).select(*g, "criterion", "n", rho.alias("spearman"))


def lost_in_3s(posts, scores, g=("platform",)):
    d = _outcomes(posts, scores, g).filter("curve is not null")
    k = kept_at(F.col("curve"), 3.0)
    d = d.withColumn("lost", 100 - let(k, lambda v: F.when(F.coalesce(v, F.lit(0.0)) == 0, 100.0).otherwise(v)))
    return exact_quantile(d.select(*g, "lost"), list(g), "lost", out="lost3")


def list_posts(posts, limit=10, g=("platform",)):
    w = Window.partitionBy(*g).orderBy(F.col("published").desc(), F.col("id"))
    return posts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def append_with_ids(store, rows, prefix, g, block, order, id_col="id", width=3):
    """Next ids after the largest one a store already holds; numbering is two-level, so one big store
    is not one task."""
    n = F.regexp_extract(id_col, rf"^{prefix}-(\d+)$", 1).try_cast("long")
    top = store.groupBy(*g).agg(F.max(n).alias("_top"))
    r = numbered(rows, list(g), block, order, "_i").join(top, list(g), "left")
    num = F.col("_i") + F.coalesce("_top", F.lit(0))
    return r.withColumn(id_col, F.concat(F.lit(prefix + "-"), F.lpad(num.cast("string"), F.greatest(F.lit(width), F.length(num.cast("string"))), F.lit("0")))).drop("_i", "_top")


def pref_add(lists, changes, keys=("owner", "section")):
    """Case-insensitive add; the opposite list of the section loses the value. The last change of a
    value decides."""
    k = [*keys, "_v"]
    ch = (changes.withColumn("_v", F.lower("value")).groupBy(*k).agg(F.max_by(F.struct("leaf", "value"), "seq").alias("_c")))
    old = lists.withColumn("_v", F.lower("value"))
    kept = old.join(ch, k, "left").filter(F.col("_c").isNull() | (F.col("_c.leaf") == F.col("leaf"))).select(*lists.columns)
    fresh = (ch.withColumn("leaf", F.col("_c.leaf")).join(old.select(*k, "leaf"), [*k, "leaf"], "left_anti")
             .select(*keys, "leaf", F.col("_c.value").alias("value")))
    return kept.unionByName(fresh)


def upsert_rules(rules, new, owner="owner"):
    """A repeated rule gains hits and takes the newest kind; a new one gets the next id of its owner."""
    k = [owner, "_t"]
    n = (new.withColumn("_t", F.lower("text")).groupBy(*k)
         .agg(F.count("*").alias("_n"), F.max_by("kind", "seq").alias("_kind"), F.min_by("text", "seq").alias("_text"), F.min("seq").alias("_first")))
    j = rules.withColumn("_t", F.lower("text")).join(n, k, "full")
    is_new = F.col("id").isNull()
    upd = j.filter(~is_new).select(owner, "id", "text", F.coalesce("_kind", "kind").alias("kind"), (F.col("hits") + F.coalesce("_n", F.lit(0))).cast("int").alias("hits"))
    add = j.filter(is_new).select(owner, F.col("_text").alias("text"), F.col("_kind").alias("kind"), (F.col("_n") - 1).cast("int").alias("hits"), "_first")
    add = append_with_ids(rules, add, "r", [owner], F.floor(F.col("_first") / 4096), ["_first"]).select(*upd.columns)
    return upd.unionByName(add)
