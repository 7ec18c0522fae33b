"""Distributed plans against brute force, under shuffled input and a hot key."""
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from framelake.operators import library as L, video as V
from framelake.plans.numbering import ROW_BITS, numbered_by_range, ranged
from framelake.plans.ordered import mid_rank, numbered
from framelake.plans.quantile import exact_quantile
from framelake.plans.ranges import no_overlap, overlap_join

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def media(spark, rows, parts):
    d = spark.createDataFrame(rows, "library_id int, id long, s double, place string")
    return d.withColumn("date", F.timestamp_micros((F.col("s") * 1e6).cast("long")).cast("timestamp_ntz")).repartition(parts)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60 * 1440)), min_size=1, max_size=60), st.integers(1, 7))
def test_sessions_any_order_any_partitions(spark, items, parts):
    rows = [(0 if lib == 0 else 1, i, float(m * 60), None) for i, (lib, m) in enumerate(items)]
    random.Random(parts).shuffle(rows)
    got = {(r.library_id, r.id): r.session for r in L.sessions(media(spark, rows, parts)).collect()}
    want = {}
    for lib in (0, 1):
        n, last = 0, None
        for _, i, s, _p in sorted((r for r in rows if r[0] == lib), key=lambda r: (r[2], r[1])):
            n += last is None or s - last > 5400
            last = s
            want[(lib, i)] = n
    assert got == want


def test_gap_is_strict(spark):
    rows = [(1, 0, 0.0, None), (1, 1, 5400.0, None), (1, 2, 10801.0, None)]
    assert [r.session for r in L.sessions(media(spark, rows, 2)).orderBy("id").collect()] == [1, 1, 2]


def test_fill_place_nearest_across_blocks(spark):
    r = random.Random(5)
    rows = [(0, i, float(r.randrange(0, 400_000)), r.choice([None, None, None, "a", "b"])) for i in range(300)]
    got = {x.id: x.place for x in L.fill_place(media(spark, rows, 5)).collect()}
    known = sorted((s, i, p) for _, i, s, p in rows if p)
    for _, i, s, p in rows:
        if p is None:
            before = max((k for k in known if (k[0], k[1]) < (s, i)), default=None)
            after = min((k for k in known if (k[0], k[1]) > (s, i)), default=None)
            b = s - before[0] if before and s - before[0] <= 7200 else None
            a = after[0] - s if after and after[0] - s <= 7200 else None
            p = before[2] if b is not None and (a is None or b <= a) else after[2] if a is not None else None
        assert got[i] == p


@pytest.mark.parametrize("kind,p", [("linear", 0.5), ("linear", 0.75), ("upper", 0.5)])
def test_exact_quantile(spark, kind, p):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=45_000), np.repeat(0.25, 15_000)])      # beyond the small-key path, with a heavy tie
    rows = [(0, float(x)) for x in v] + [(1, float(x)) for x in range(4)]
    d = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: r.q for r in exact_quantile(d, ["k"], "v", p, kind).collect()}
    big = np.sort(v)[len(v) // 2] if kind == "upper" else np.quantile(v, p)
    assert got[0] == pytest.approx(big, abs=1e-12) and got[1] == (2 if kind == "upper" else np.quantile(range(4), p))


def test_mid_rank_and_numbers(spark):
    r = random.Random(1)
    vals = [r.randrange(0, 40) / 4 for _ in range(200)]
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(vals)], "g int, i int, x double").repartition(4)
    got = {a.i: a.r for a in mid_rank(d, ["g"], "x", 1.0, "r").collect()}
    s = sorted(vals)
    assert all(got[i] == (s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for i, x in enumerate(vals))
    n = {a.i: a.n for a in numbered(d, ["g"], F.floor("x"), ["x", "i"]).collect()}
    assert [i for i, _ in sorted(n.items(), key=lambda t: t[1])] == [i for i, _ in sorted(enumerate(vals), key=lambda t: (t[1], t[0]))]


def test_numbers_of_a_key_whose_rows_share_one_day(spark):
    r = random.Random(4)
    rows = [(1 if i % 50 else None if i % 100 else 2, 86_400.0 + r.randrange(3600) / 4, i) for i in range(20_000)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "g int, s double, i int").repartition(6)
    want, at = {}, {}
    for g, s, i in sorted(rows, key=lambda x: x[1:]):
        want[i] = at[g] = at.get(g, 0) + 1
    assert {a.i: a.n for a in numbered_by_range(d, ["g"], ["s", "i"]).collect()} == want
    assert numbered_by_range(d.limit(0), ["g"], ["s", "i"]).count() == 0


def test_a_hot_day_is_many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")        # the test table is small enough for one task
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        d = spark.range(40_000).selectExpr("1 AS g", "86400D + pmod(hash(id), 3600) AS s", "id AS i")
        sizes = [x["count"] for x in ranged(d, ["g"], ["s", "i"]).groupBy(F.shiftright("_at", ROW_BITS)).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_overlap_join_is_whole_and_unique(spark):
    r = random.Random(2)
    iv = lambda n, w: [(0 if r.random() < .7 else 1, i, a := r.random() * 50, a + r.random() * w) for i in range(n)]
    a, b = iv(80, 9), iv(80, 3)
    x = spark.createDataFrame(a, "k int, i int, a0 double, a1 double")
    y = spark.createDataFrame(b, "k int, j int, b0 double, b1 double")
    got = sorted((q.i, q.j) for q in overlap_join(x, y, ["k"], ("a0", "a1"), ("b0", "b1"), 2.0).collect())
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])
    assert got == want
    alone = {q.i for q in no_overlap(x, y, ["k"], ["i"], ("a0", "a1"), ("b0", "b1"), 2.0).collect()}
    assert alone == {p[1] for p in a} - {i for i, _ in want}


@SLOW
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 40)), min_size=1, max_size=25))
def test_merge_windows(spark, items):
    rows = [(1, a / 10, (a + n) / 10) for a, n in items]
    got = [(r.t0, r.t1) for r in V.merge_windows(spark.createDataFrame(rows, "video_id int, t0 double, t1 double").repartition(3), 0.5).orderBy("t0").collect()]
    want = []
    for _, a, b in sorted(rows):
        if want and a - want[-1][1] <= 0.5:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(round(x, 3) for x in w) for w in want]


def test_phrases_between_silences(spark):
    sil = spark.createDataFrame([(1, 0.2, 1.0), (1, 3.0, 3.5), (1, 3.7, 5.0), (2, 0.0, 9.0)], "video_id int, s0 double, s1 double")
    tot = spark.createDataFrame([(1, 6.0), (2, 9.1), (3, 2.0)], "video_id int, total_s double")
    got = sorted(tuple(r) for r in V.silence_phrases(sil, tot).select("video_id", "phrase", "start", "end", "pause_before", "pause_after").collect())
    assert got == [(1, 0, 1.0, 3.0, 1.0, 2.0), (1, 1, 5.0, 6.0, 2.0, 0.0), (3, 0, 0.0, 2.0, 0.0, 0.0)]
