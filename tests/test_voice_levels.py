"""Levels of lines and of the quiet stretches around them."""
from framelake.operators import video as V


def test_samples_meet_lines_and_stretches_in_one_join(spark, monkeypatch):
    joined, plain = [], V.overlap_join
    monkeypatch.setattr(V, "overlap_join", lambda a, b, *x, **y: joined.append(b.columns) or plain(a, b, *x, **y))
    lines = spark.createDataFrame([(1, 0, 2.0, 1.6, "a"), (1, 1, 6.0, 1.6, "b"), (2, 0, 0.0, None, "c")], "video_id long, i int, start_s double, duration_s double, text string")
    totals = spark.createDataFrame([(1, 10.0), (2, 3.0), (3, 5.0)], "video_id long, total_s double")
    db = lambda t: -10.0 if 2 <= t <= 3.5 or 6 <= t <= 7.5 else -30.0 if t < 5 else -50.0
    samples = spark.createDataFrame([(v, k / 2, db(k / 2)) for v, end in ((1, 20), (2, 6), (3, 10)) for k in range(end + 1)], "video_id long, t double, db double")
    got = {(r.video_id, r.i): (r.level, r.background) for r in V.voice_levels(lines, samples, totals).collect()}
    assert sum("db" in x for x in joined) == 1
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert got[1, 0][0] == got[1, 1][0] == -10.0 and got[1, 0][1] is not None and got[1, 0][1] <= -30.0
