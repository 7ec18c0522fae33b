"""The trailing fade of a video."""
from framelake.operators import video as V


def test_fade_reads_its_frames_once(spark):
    """One aggregation of the frames and no window: they are neither shuffled again nor ordered as a whole."""
    rows = [(v, i * 0.25, 100.0 if i < 32 else 100.0 - (i - 31) * 12) for v in (1, 2) for i in range(40)] + [(3, 0.25 * i, None if i == 39 else 90.0) for i in range(40)] + [(4, 0.0, 90.0)]
    frames = spark.createDataFrame(rows, "video_id int, t double, y double")
    totals = spark.createDataFrame([(v, 10.0) for v in (1, 2, 3, 4)], "video_id int, total_s double")
    got = V.fade(frames, totals)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
    assert {r.video_id: r.fade_s for r in got.collect()} == {1: 2.0, 2: 2.0, 3: 0.0}
