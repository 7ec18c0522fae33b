"""Exact numbers and regressions on small literal fixtures."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from framelake.operators import contracts as C, gate as G, library as L, moments as M, people as Pe, posts as P, rules as R, text as X, video as V


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_beat_grid(spark):
    s = spark.createDataFrame([("v", 0, 2, None, None, None), ("v", 1, 4, None, None, None), ("v", 2, 3, None, None, None)], "variant_id string, i int, beats int, dur double, line int, line_s double")
    m = spark.createDataFrame([("v", 120.0, 0.5)], "variant_id string, bpm double, beat0 double")
    assert [r.t1 for r in V.cut_grid(s, m).orderBy("i").collect()] == [1.5, 3.5, 5.0]


def test_narrated_grid(spark):
    s = spark.createDataFrame([("v", 0, None, None, 0, 1.1), ("v", 1, None, None, 1, 1.0)], "variant_id string, i int, beats int, dur double, line int, line_s double")
    m = spark.createDataFrame([("v", 120.0, 0.0)], "variant_id string, bpm double, beat0 double")
    g = V.cut_grid(s, m, lead=0.1, tail=0.2, close_hold=0.5).orderBy("i").collect()
    assert [r.t1 for r in g] == [1.5, 3.25] and g[1].voice_at == pytest.approx(1.6)


def test_split_long_holds(spark):
    g = spark.createDataFrame([("v", 0, 0.0, 2.0, 2.0, None, 0.0, False, True), ("v", 1, 2.0, 10.0, 8.0, 0, 0.0, False, True), ("v", 2, 10.0, 16.0, 6.0, None, 0.0, True, True)],
                              "variant_id string, i int, t0 double, t1 double, dur double, line int, start_s double, hero boolean, splittable boolean")
    p = V.split_long(g).orderBy("new_i").collect()
    assert len(p) == 6 and p[-1].p1 == 16.0 and sum(r.dur for r in p) == pytest.approx(16.0)
    assert (p[2].zoom, p[2].start_s) == (1.22, 2.0) and [r.line for r in p] == [None, 0, None, None, None, None]
    caps = spark.createDataFrame([("v", 2)], "variant_id string, seg int")
    assert V.remap_captions(caps, V.split_long(g)).first().seg == 5


def test_frame_decision(spark):
    sch = ("moment_id int, at_s int, crossing_lines array<struct<axis:string,at:double,len:double>>, haze double, contrast double, clear_band double, people_bottom double, people_middle double, faces array<struct<cy:double,height_share:double>>")
    boat = (1, 0, [], 0.2, 60.0, 0.9, 0.5, 0.1, [])
    selfie = (2, 0, [], 0.2, 60.0, 0.9, 0.5, 0.1, [(0.7, 0.3)])
    got = {r.moment_id: r.obstructions for r in M.frame_decision(spark.createDataFrame([boat, selfie], sch)).collect()}
    assert got == {1: ["foreground_people"], 2: []}


def test_contradictions(spark):
    lines = spark.createDataFrame([("p", 1, "Llegué solo a Lisboa."), ("p", 2, "Llegué solo, sin Ana, desde Roma."), ("p", 3, "Fuimos juntos.")], "project string, n int, text string")
    facts = spark.createDataFrame([("p", "f-001", r"llegu[ée] solo", "desde Roma")], "project string, fact string, forbid string, allow_if string")
    assert [r.n for r in R.contradictions(lines, facts).collect()] == [1]


def test_guard_labels(spark):
    texts = ["see /home/ana/x", "me@site.org", "IMG_1234 please", "call +52 55 1234 5678", "my password", "keep it short", " ", "x" * 201]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.refused for r in R.guard(d).orderBy("i").collect()]
    assert got == ["a home folder path", "an email address", "a camera file name", "a phone number", "a credential", None, "empty", "too long"]


def test_rule_or_fact_and_lexicon(spark):
    d = spark.createDataFrame([("We travelled with Ana until May",), ("No shots of food",)], "text string")
    assert [r.factlike for r in R.looks_like_fact(d).collect()] == [True, False]
    lines = spark.createDataFrame([("es-MX", "Vamos a Downtown Loop, downtown.")], "lang string, text string").withColumn("l2", F.substring("lang", 1, 2))
    lex = spark.createDataFrame([("es", 0, "downtown", "x"), ("es", 1, "downtown", "dauntáun"), ("es", 0, "downtown loop", "dauntáun lup")], "lang string, layer int, term string, say string")
    assert X.apply_lexicon(lines, lex, ["text"], lang="l2").first().spoken == "Vamos a dauntáun lup, dauntáun."


def test_private_kind(spark):
    t = spark.createDataFrame([("VK 9312",), ("ABC-123-D",), ("51D",), ("+52 55 1234 5678",), ("a@b.co",), ("Exit",)], "t string")
    assert [r.k for r in t.select(R.private_kind("t").alias("k")).collect()] == ["plate", "plate", None, "phone", "email", None]


def test_gate_renewal(spark):
    v = spark.createDataFrame([(1, 12.0)], "video_id int, picture_s double")
    sch = "video_id int, i int, t0 double, t1 double, dur double, hero boolean"
    shots = lambda hero: spark.createDataFrame([(1, 0, 0.0, 2.0, 2.0, False), (1, 1, 2.0, 11.0, 9.0, hero), (1, 2, 11.0, 12.0, 1.0, False)], sch)
    caps = spark.createDataFrame([(1, 0, 0.0, 1.0, "look at this")], "video_id int, i int, t0 double, t1 double, text string")
    voice = caps.limit(0).select("video_id", "t0", "t1")
    assert G.gt_renewal(v, shots(False), caps, voice).first().status == "fail"
    assert G.gt_renewal(v, shots(True), caps, voice).first().status == "pass"
    assert G.gt_hook(v, shots(False), caps, voice).first().status == "pass"


def test_skip_is_never_a_pass(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 10.0, None, None)], "video_id int, audio_tracks int, audio_s double, picture_s double, expected_s double, peak_db double")
    assert G.gt_peak(v).first().status == "skip" and G.gt_audio_track(v).first().status == "fail"


def test_text_unification(spark):
    c = spark.createDataFrame([(1, 0, 0.0, "box", "spec"), (1, 1, 1.0, "serif", "spec"), (1, 2, 2.0, "clean", "sync"), (1, 3, 3.0, "pin", "spec")], "video_id int, i int, t0 double, style string, source string").withColumn("keep_style", F.lit(False))
    assert [r.style for r in X.unify_text(c).orderBy("i").collect()] == ["box", "box", "clean", "pin"]


def test_moved_files(spark):
    """The same names in two projects: a path is only repaired to a file of its own project."""
    m = spark.createDataFrame([(p, *r) for p in (1, 2) for r in [("a", "old/IMG_1.mov", "video", 4.0, None), ("b", "old/gone.jpg", "photo", None, None), ("c", "old/GX01.mp4", "video", 9.0, None)]],
                              "project_id int, id string, path string, type string, end_s double, notes string")
    f = spark.createDataFrame([(1, "/p/proj/new/img_1.MOV", 10, 5.0), (1, "/p/x/proxy-gx01_s.mp4", 5, 9.0), (1, "/p/x/xgx01.mp4", 50, 99.0), (2, "/q/gx01.MP4", 5, 9.0)], "project_id int, path string, bytes int, duration_s double")
    a = M.repair_paths(m, f, "/p/proj")
    b = M.working_copies(a.filter("now is null").drop("now", "how"), f, "/p/proj")
    lib = spark.createDataFrame([(1, "GONE.JPG", "U1", False), (2, "IMG_1.MOV", "U2", False)], "project_id int, original_name string, uuid string, trashed boolean")
    assert {(r.project_id, r.id): r.now for r in a.collect() if r.now} == {(1, "a"): "/p/proj/new/img_1.MOV", (2, "c"): "/q/gx01.MP4"}
    assert {(r.project_id, r.id): r.now for r in b.collect()} == {(1, "b"): None, (1, "c"): "/p/x/proxy-gx01_s.mp4", (2, "a"): None, (2, "b"): None}
    got = {(r.project_id, r.id): r.notes for r in M.library_fallback(b.filter("now is null"), lib).collect()}
    assert got == {(1, "b"): "file_state=library:U1", (2, "a"): "file_state=library:U2", (2, "b"): "file_state=lost"}


def test_findings_are_kept_whole(spark):
    m = spark.createDataFrame([(1, "x", "old"), (1, "y", None)], "project_id int, id string, notes string")
    long = ["private_plate", "blocking_people " + "z" * 300, "vertical_edge", "vertical_edge"]
    r = spark.createDataFrame([(1, "x", ["foreground_people"], long, 2.5)], "project_id int, id string, obstructions array<string>, findings array<string>, at_s double")
    once = M.annotate_moments(m, r)
    want = "old | frame_private=private_plate | frame_look=" + "; ".join(long) + " @2.5"
    assert {x.id: x.notes for x in once.collect()} == {"x": want, "y": None}
    assert {x.id: x.notes for x in M.annotate_moments(once, r).collect()} == {"x": want, "y": None}


def test_places_as_objects_and_facts_per_project(spark):
    m = spark.createDataFrame([(1, "Lisboa", None, ("Porto", None)), (1, None, None, (None, "Porto")), (2, "Porto", None, None)], "project_id int, place string, location string, city struct<name:string,city:string>")
    f = spark.createDataFrame([(1, "porto"), (1, "PORTO"), (3, "Porto")], "project_id int, place string")
    assert {(r.project_id, r.place): (r.uses, r.facts) for r in R.place_coverage(m, f).collect()} == {(1, "Lisboa"): (1, 0), (1, "Porto"): (2, 2), (2, "Porto"): (1, 0)}


def test_nested_artifact_texts(spark):
    body = '{"text":"top","skip":"no","lines":[{"text":"a","n":1,"deep":{"caption":"b","x":["c",{"title":"d","id":"e"}]}},"f",null,2.5],"text2":{"says":"g"}}'
    d = spark.createDataFrame([(1, body), (2, "first \n\n third"), (3, '"just a text"'), (4, None), (5, "[]")], "artifact int, body string")
    got = sorted((r.artifact, r.where, r.text) for r in R.artifact_texts(d).collect())
    assert got == [(1, ".lines[0].deep.caption", "b"), (1, ".lines[0].deep.x[0]", "c"), (1, ".lines[0].deep.x[1].title", "d"), (1, ".lines[0].text", "a"), (1, ".lines[1]", "f"), (1, ".text", "top"),
                   (1, ".text2.says", "g"), (2, ":1", "first"), (2, ":3", "third")]


def test_quantiles_narrow_to_the_ranks(spark, monkeypatch):
    from framelake.plans import quantile as Q
    monkeypatch.setattr(Q, "FEW", 3)
    monkeypatch.setattr(Q, "BINS", 4)
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=101), np.concatenate([rng.normal(size=50), [1e300, -1e300, 5, 5, 5, 5]]), np.zeros(7), np.array([3.0]), rng.integers(0, 4, 40).astype(float)):
        df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in values] + [("a", None)], "g string, v double")
        for p in (0.0, 0.3, 0.5, 1.0):
            assert {r.g: r.q for r in Q.exact_quantile(df, ["g"], "v", p).collect()} == pytest.approx({g: float(np.quantile(values, p)) for g in "ab"})
        assert Q.exact_quantile(df, [], "v", kind="upper").first().q == sorted([*values, *values])[len(values)]


def test_calibration(spark):
    posts = spark.createDataFrame([(i, "tiktok", 10.0, None, 20.0 + 10 * i, None) for i in range(4)], "id int, platform string, duration_s double, avg_watch_s double, watch_pct double, retention_text string")
    scores = spark.createDataFrame([(i, "A1", 2 + i) for i in range(4)] + [(i, "B1", 5) for i in range(4)], "post_id int, criterion string, score int")
    got = {r.criterion: r.spearman for r in P.calibrate(posts, scores).collect()}
    assert got["A1"] == pytest.approx(1.0) and got["B1"] == 0.0


def test_flat_thumbnails(spark):
    d = spark.createDataFrame([("dark", [20] * 64), ("card", [128] * 64), ("busy", [0, 255] * 32)], "k string, px array<int>")
    assert {r.k: r.f for r in d.select("k", Pe.frame_flat(F.col("px")).alias("f")).collect()} == {"dark": True, "card": True, "busy": False}


def test_word_recall(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 2.0, "Nunca había visto tanta niebla")], "video_id int, i int, w0 double, w1 double, text string")
    heard = spark.createDataFrame([(1, "nunca", 0.1), (1, "habia", 0.4), (1, "visto", 0.7), (1, "niebla", 9.0)], "video_id int, text string, t0 double")
    assert V.recall(lines, heard).first().recall == pytest.approx(0.6)


def test_private_text(spark):
    w = spark.createDataFrame([(1, "VK", 0.9, 0.1, 0.5, 0.15, 0.55), (1, "9312", 0.9, 0.17, 0.5, 0.25, 0.55), (1, "51D", 0.9, 0.1, 0.8, 0.2, 0.85)], "frame int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.kind, r.text) for r in X.private_text(w).collect()] == [("plate", "VK 9312")]


def test_script_readers(spark):
    d = spark.createDataFrame([(1, '{"lines":[{"start_s":0.0,"text":"a b","duration_hint_s":1.4},{"t":2.5,"text":"c d","start_x":1,"dur":1.6},{"start_s":5.0,"text":"e"}]}')], "script_id int, body string")
    got = X.read_voice_lines(d).orderBy("i").collect()
    assert [r.start_s for r in got] == [0.0, 2.5, 5.0] and [r.duration_s for r in got] == [1.4, 1.6, None]


def test_veto_and_ranking(spark):
    m = spark.createDataFrame([Row(project_id=1, id=f"m{i}", date=dt.datetime(2024, 1, i + 1), notes=None if i else "n", use=None) for i in range(3)], "project_id int, id string, date timestamp, notes string, use boolean")
    idx = M.sheet_index(m, 30)
    out = {r.id: r.use for r in M.veto(m, idx, spark.createDataFrame([(1, 2)], "project_id int, n long")).collect()}
    assert out == {"m0": None, "m1": False, "m2": None}


def test_human_anchor(spark):
    stories = spark.createDataFrame([(1, "s-001")], "project_id int, id string")
    sch = "concept_id int, project_id int, human_anchor boolean, stories array<string>"
    assert C.check_human(spark.createDataFrame([(1, 1, False, [])], sch), stories).count() == 2
    assert C.check_human(spark.createDataFrame([(1, 1, True, ["s-001"])], sch), stories).count() == 0


def test_name_dates(spark):
    n = spark.createDataFrame([("IMG_20260815_143012.jpg",), ("2026-08-15 14.30.12.jpg",), ("VID_20240115.mp4",), ("IMG_4934.MOV",), ("P_20240101_995959.jpg",), ("X_20241399.jpg",)], "name string")
    got = [r.name_date for r in L.dates_from_names(n).collect()]
    assert got == [dt.datetime(2026, 8, 15, 14, 30, 12)] * 2 + [dt.datetime(2024, 1, 15, 12), None, dt.datetime(2024, 1, 1, 12), None]


def test_quantile_between_two_far_clusters(spark, monkeypatch):
    """The two middle values lie in the first and the last bin: the interval would never get smaller."""
    from framelake.plans import quantile as Q
    monkeypatch.setattr(Q, "FEW", 10)
    low, high = [i / 1e6 for i in range(40)], [100 + i / 1e6 for i in range(40)]
    rows = [("a", v) for v in low + high] + [("b", 7.0)] * 50 + [("c", float(i)) for i in range(3)]
    got = {r.g: (r.q, r.n) for r in Q.exact_quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", n="n").collect()}
    assert got == {"a": (low[-1] + (high[0] - low[-1]) * 0.5, 80), "b": (7.0, 50), "c": (1.0, 3)}


def test_quantile_shuffles_bins_and_not_values(spark, monkeypatch, tmp_path):
    """A key with many different values leaves a task as rows of bins."""
    from framelake.plans import quantile as Q
    seen = []
    narrowed = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda v, s, k: seen.append(s.first()) or narrowed(v, s, k))
    q = Q.exact_quantile(spark.range(60_000).selectExpr("'a' g", "cast(id as double) v"), ["g"], "v").first().q
    assert q == 29_999.5 and len(seen) == 1
