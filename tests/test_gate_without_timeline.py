"""Checks of videos whose timeline is missing or only worked out from a spec."""
from framelake.operators import gate as G

VIDEO = "video_id int, audio_tracks int, picture_s double, fade_out double, loop boolean, seam_db double, taper_db double, partial boolean"


def test_ending_by_the_picture(spark):
    videos = spark.createDataFrame([(i, 1, 10.0, None, False, None, 2.0, False) for i in (1, 2, 3)], VIDEO)
    shots = spark.createDataFrame([], "video_id int, i int, t0 double, t1 double, dur double, src string")
    caps = spark.createDataFrame([], "video_id int, i int, t0 double, t1 double, text string")
    voice = spark.createDataFrame([], "video_id int, i int, t0 double, t1 double")
    frames = spark.createDataFrame([(v, t / 5, 100.0, 1.0) for v in (1, 2, 3) for t in range(50)], "video_id int, t double, y double, d double")
    blacks = spark.createDataFrame([(1, 9.2, 9.95)], "video_id int, t0 double, t1 double")
    cuts = spark.createDataFrame([(2, 9.7), (3, 4.0)], "video_id int, t double")
    d = {r.video_id: r for r in G.ending_symptoms(videos, shots, caps, voice, frames, blacks, cuts).collect()}
    assert not d[1].no_fade and d[2].no_fade and d[3].no_fade
    assert d[2].short_last and not d[3].short_last and not d[1].short_last
    s = {r.video_id: r.status for r in G.gt_ending(videos, shots, caps, voice, frames, blacks, cuts).collect()}
    assert s == {1: "pass", 2: "warn", 3: "warn"}        # flat sound and no fade; a cut just before the end


def test_partial_timeline_with_script_is_narrated(spark):
    videos = spark.createDataFrame([(1, 1, 10.0, None, False, None, None, True), (2, 1, 10.0, None, False, None, None, False)], VIDEO)
    caps = spark.createDataFrame([(v, 0, 1.0, 2.0, "hello there", None, None) for v in (1, 2)], "video_id int, i int, t0 double, t1 double, text string, audio_t0 double, source string")
    voice = spark.createDataFrame([], "video_id int, i int, t0 double, t1 double")
    script = spark.createDataFrame([(v, 0, 1.1, "hello there") for v in (1, 2)], "video_id int, i int, start_s double, text string")
    got = {r.video_id: r.status for r in G.gt_text_sync(videos, caps, voice, script).collect()}
    assert got == {1: "pass", 2: "skip"}
