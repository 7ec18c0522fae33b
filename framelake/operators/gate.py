"""The delivery gate: one row per video and check with pass, warn, fail or skip. A skip is never a pass."""
from pyspark.sql import Window, functions as F

from framelake.operators import video as V
from framelake.plans.similarity import written_by, written_once

K = "video_id"
# The gate's ceilings and floors.
LIMITS = dict(tolerance=0.25, audio_tolerance=0.3, max_silence=0.6, peak=-0.5, voice_margin=4.0, recall=0.6, loop_seam_db=18.0, text_tolerance=0.25, cut_tolerance=0.35,
              min_last_shot=0.6, closer_window=1.2, max_end_motion=1.8, min_end_taper=6.0, max_stale=5.0, max_voice_hold=4.0, max_mean_shot=3.0, min_cv=0.3, hook_words=8,
              max_mb=280.0, max_preview_mb=30.0)


def _row(df, check, status, value, detail):
    return df.select(K, F.lit(check).alias("check"), status.alias("status"), value.cast("double").alias("value"), detail.alias("detail"))


def _pf(ok, bad="fail"):
    return F.when(ok, "pass").otherwise(bad)


def _fmt(text, *xs):
    return F.format_string(text, *xs)


def _by_video(df):
    """What a check finds, a few numbers a video, is written: what was dealt out to find it is freed before the next check runs."""
    return written_once(df)


def _has_audio(v):
    return v.filter("audio_tracks > 0").select(K)


def gt_audio_track(videos):
    ok = (F.col("audio_tracks") == 1) & (F.col("audio_s") > 0)
    return _row(videos, "audio_track", _pf(ok), F.col("audio_tracks"), F.when(F.col("audio_tracks") > 0, _fmt("%d audio track(s), %.2f s", "audio_tracks", "audio_s")).otherwise("no audio track"))


def gt_duration(videos, tolerance=LIMITS["tolerance"]):
    gap = F.abs(F.col("picture_s") - F.col("audio_s"))
    ok = (F.col("audio_tracks") > 0) & (gap <= max(tolerance, LIMITS["audio_tolerance"])) & (F.coalesce("expected_s", F.lit(0.0)).isin(0.0) | (F.abs(F.col("picture_s") - F.col("expected_s")) <= tolerance))
    return _row(videos, "duration", _pf(ok), gap, _fmt("picture %.2f s, audio %.2f s", "picture_s", "audio_s"))


def gt_black_frames(videos, blacks):
    bad = blacks.join(videos.select(K, "picture_s"), K).filter(F.col("t0") < F.greatest(F.lit(0.0), F.col("picture_s") - 1.0)).groupBy(K).agg(F.count("*").alias("_n"))
    d = videos.select(K).join(bad, K, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _row(d, "black_frames", _pf(F.col("_n") == 0), F.col("_n"), _fmt("%d black window(s) before the last second", "_n"))


def gt_silence(videos, events, max_silence=LIMITS["max_silence"]):
    gaps = V.pair_silences(events, videos.select(K, F.col("picture_s").alias("total_s")), shortest=max_silence).groupBy(K).agg(F.count("*").alias("_n"))
    gaps = _by_video(gaps)
    d = videos.select(K, "audio_tracks").join(gaps, K, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _row(d, "silence", F.when(F.col("audio_tracks") == 0, "skip").otherwise(_pf(F.col("_n") == 0)), F.when(F.col("audio_tracks") > 0, F.col("_n")), _fmt("%d hole(s)", "_n"))


def gt_peak(videos, peak=LIMITS["peak"]):
    s = F.when((F.col("audio_tracks") == 0) | F.col("peak_db").isNull(), "skip").otherwise(_pf(F.col("peak_db") <= peak))
    return _row(videos, "peak", s, F.when(F.col("audio_tracks") > 0, F.col("peak_db")), _fmt("true peak %.2f dBTP", "peak_db"))


def gt_voice_audible(videos, lines, samples, heard=None, margin=LIMITS["voice_margin"]):
    """A line under the level margin is still fine when its words are understood in the mix."""
    totals = videos.select(K, F.col("picture_s").alias("total_s"))
    win = written_once(V.speech_windows(lines, totals))
    spoken = win.select(K)
    weak = V.weak_lines(V.voice_levels(lines, samples, totals, win=win), margin).filter("weak is not null").select(K, "i")
    if heard is not None:
        win = written_once(win.join(weak, [K, "i"], "left_semi"))
        weak = V.recall(win, heard).filter(F.col("recall") < LIMITS["recall"]).select(K, "i")
    n = _by_video(weak.groupBy(K).agg(F.count("*").alias("_n")))
    has = spoken.distinct().withColumn("_l", F.lit(True))
    d = videos.select(K, "audio_tracks").join(has, K, "left").join(n, K, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    can = F.col("_l").isNotNull() & (F.col("audio_tracks") > 0)
    return _row(d, "voice_audible", F.when(can, _pf(F.col("_n") == 0)).otherwise("skip"), F.when(can, F.col("_n")), _fmt("%d line(s) not over the background", "_n"))


def gt_text_sync(videos, caps, voice, script=None, tolerance=LIMITS["text_tolerance"]):
    """Captions against the second the voice says them; hand-typed text falls back to line openers. A video counts as
    narrated by its voice windows, or by having a script where its timeline is only worked out from a spec (partial)."""
    sync = caps.filter("audio_t0 is not null").select(K, (F.col("t0") - F.col("audio_t0")).alias("drift"))
    if script is not None:
        have = sync.select(K).distinct()
        narrated = voice.select(K).distinct()
        if "partial" in videos.columns:
            narrated = narrated.unionByName(videos.filter("partial").select(K)).distinct()
        free = caps.filter(F.coalesce("source", F.lit("spec")).isin("spec", "cut"))
        op = V.line_openers(script.join(have, K, "left_anti").join(narrated, K, "left_semi"), free).select(K, (F.col("cap_t0") - F.col("start_s")).alias("drift"))
        sync = sync.unionByName(op)
    w = _by_video(sync.groupBy(K).agg(F.max(F.abs("drift")).alias("worst"), F.count("*").alias("_n")))
    d = videos.select(K).join(w, K, "left")
    return _row(d, "text_sync", F.when(F.col("worst").isNull(), "skip").otherwise(_pf(F.col("worst") <= tolerance)), F.col("worst"), _fmt("%d caption(s) against the voice, worst drift %.2f s", "_n", "worst"))


def gt_text_cut(videos, caps, shots, tolerance=LIMITS["cut_tolerance"]):
    n = _by_video(V.text_cut(caps, shots, tolerance).groupBy(K).agg(F.count("*").alias("_n")))
    can = caps.select(K).distinct().join(shots.filter("i = 1").select(K), K, "left_semi").withColumn("_c", F.lit(True))
    d = videos.select(K).join(can, K, "left").join(n, K, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _row(d, "text_cut", F.when(F.col("_c").isNull(), "skip").otherwise(_pf(F.col("_n") == 0, "warn")), F.when(F.col("_c"), F.col("_n")), _fmt("%d text(s) outlive their shot", "_n"))


def gt_voice_image(videos, shots, words, tolerance=LIMITS["text_tolerance"]):
    r = _by_video(V.voice_image(shots, words, tolerance).groupBy(K).agg(F.count("*").alias("_p"), F.count_if(F.col("status") != "ok").alias("_n")))
    d = videos.select(K).join(r, K, "left").join(words.select(K).distinct().withColumn("_w", F.lit(True)), K, "left")
    can = F.col("_p").isNotNull() & F.col("_w").isNotNull()
    return _row(d, "voice_image", F.when(can, _pf(F.col("_n") == 0)).otherwise("skip"), F.when(can, F.col("_n")), _fmt("%d of %d promise(s) broken", "_n", "_p"))


def ending_symptoms(videos, shots, caps, voice, frames, blacks=None, cuts=None):
    """Every measured symptom of a video that stops instead of ending; nulls stay unknown. A video without a timeline is
    judged by its picture: it fades if its last frames do or a black window (video_id, t0, t1) closes it, and its last
    shot runs from the last cut seen (video_id, t)."""
    totals = videos.select(K, F.col("picture_s").alias("total_s"))
    hint = videos.select(K, "fade_out")
    raw = written_once(V.fade(frames, totals))
    fades = raw.join(hint, K).select(K, "total_s", F.greatest("fade_s", F.coalesce("fade_out", F.lit(0.0))).alias("fade_s"))
    prof = _by_video(V.end_motion(frames, fades, totals).select(K, "motion"))
    seen = raw.select(K, (F.col("fade_s") > 0.08).alias("_faded"))
    ends = shots.groupBy(K).agg(F.max_by(F.struct("dur", "t0", "src"), "i").alias("z"), F.min_by("src", "i").alias("src0"), F.count("*").alias("n_shots"))
    cl = caps.groupBy(K).agg(F.max("t1").alias("_ct"))
    vt = voice.groupBy(K).agg(F.max("t1").alias("voice_tail"))
    d = videos.join(prof, K, "left").join(ends, K, "left").join(cl, K, "left").join(vt, K, "left").join(seen, K, "left")
    if blacks is not None:
        d = d.join(blacks.groupBy(K).agg(F.max("t1").alias("_dark")), K, "left").withColumn("_faded", F.coalesce("_faded", F.lit(False)) | F.coalesce(F.col("_dark") >= F.col("picture_s") - 0.15, F.lit(False)))
    if cuts is not None:
        last = cuts.join(totals, K).filter(F.col("t") < F.col("total_s") - 0.05).groupBy(K).agg(F.max("t").alias("_cut"))
        d = d.join(last, K, "left")
    held = F.coalesce(F.col("z.dur"), F.col("picture_s") - F.col("_cut")) if cuts is not None else F.col("z.dur")
    faded = F.when(F.col("z").isNull(), F.coalesce("_faded", F.lit(False))).otherwise(F.coalesce(F.col("fade_out") > 0.05, F.lit(False)))
    d = d.withColumn("motion", F.when(F.col("picture_s") > 1.0, F.col("motion")))
    b = lambda x: F.coalesce(x, F.lit(False))
    return (d.withColumn("short_last", b(held < LIMITS["min_last_shot"])).withColumn("moving", b(F.col("motion") >= LIMITS["max_end_motion"]))
            .withColumn("flat_sound", b((F.col("audio_tracks") > 0) & (F.col("taper_db") < LIMITS["min_end_taper"]))).withColumn("no_fade", ~faded)
            .withColumn("no_closer", b(F.col("_ct") < F.col("picture_s") - LIMITS["closer_window"])).withColumn("voice_to_end", b(F.col("voice_tail") > F.col("picture_s") - 0.15))
            .withColumn("symptoms", sum((F.col(x).cast("int") for x in ("short_last", "moving", "flat_sound", "no_fade", "no_closer", "voice_to_end")), F.lit(0))))


def gt_ending(videos, shots, caps, voice, frames, blacks=None, cuts=None):
    d = ending_symptoms(videos, shots, caps, voice, frames, blacks, cuts)
    bad = (F.col("symptoms") >= 2) | F.col("moving") | (F.col("short_last") & F.col("no_fade"))
    loop = F.coalesce("loop", F.lit(False))
    again = ~loop & (F.col("n_shots") > 2) & (F.col("z.src") == F.col("src0"))
    status = (F.when(loop, F.when(F.col("seam_db").isNull(), "skip").otherwise(_pf(F.col("seam_db") >= LIMITS["loop_seam_db"], "warn")))
              .when(F.col("z").isNull() & F.col("_ct").isNull() & F.col("motion").isNull() & F.col("taper_db").isNull(), "skip").when(bad | F.coalesce(again, F.lit(False)), "warn").otherwise("pass"))
    return _row(d, "ending", status, F.when(loop, F.col("seam_db")).otherwise(F.col("symptoms")), _fmt("%d symptom(s)", "symptoms"))


def _no_shots(videos, shots, check):
    return _row(videos.join(shots.select(K).distinct(), K, "left_anti"), check, F.lit("skip"), F.lit(None), F.lit("no timeline with shots"))


def gt_renewal(videos, shots, caps, voice, max_stale=LIMITS["max_stale"]):
    r = _by_video(V.renewal(shots, caps, voice, videos.select(K, F.col("picture_s").alias("total_s"))))
    return _row(r, "renewal", _pf(F.col("stale_s") <= max_stale), F.col("stale_s"), _fmt("longest wait %.1f s from %.2f s", "stale_s", "at_s")).unionByName(_no_shots(videos, shots, "renewal"))


def gt_picture_with_voice(videos, shots, voice, hold=LIMITS["max_voice_hold"]):
    """Videos with no voice have no row, as nothing is claimed about them."""
    s = V.talk_in_shot(shots, voice).filter(~F.coalesce("hero", F.lit(False)) & (F.col("talk_s") > 0.6 * F.col("dur"))).groupBy(K).agg(F.max("dur").alias("held"))
    s = _by_video(s)
    d = voice.select(K).distinct().join(shots.select(K).distinct(), K, "left_semi").join(s, K, "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    return _row(d, "picture_with_voice", _pf(F.col("held") <= hold), F.col("held"), _fmt("longest narrated take %.1f s", "held")).unionByName(_no_shots(videos, shots, "picture_with_voice"))


def gt_pace(videos, shots):
    p = V.pacing(shots, videos.select(K, F.col("picture_s").alias("total_s")))
    curve = _row(p.filter("shots >= 6"), "pace_curve", _pf(F.coalesce("cv", F.lit(0.0)) >= LIMITS["min_cv"], "warn"), F.coalesce("cv", F.lit(0.0)), _fmt("shot lengths vary %.2f", "cv"))
    mean = _row(p, "pace", _pf(F.col("mean") <= LIMITS["max_mean_shot"], "warn"), F.col("mean"), _fmt("%d shots, mean %.1f s, longest %.1f s, cuts per third %d %d %d", "shots", "mean", "longest", "third1", "third2", "third3"))
    return curve.unionByName(mean).unionByName(_no_shots(videos, shots, "pace_curve")).unionByName(_no_shots(videos, shots, "pace"))


def gt_hook(videos, shots, caps, voice, most=LIMITS["hook_words"]):
    h = caps.filter("t0 <= 0.5").groupBy(K).agg(F.min_by("text", F.struct("t0", "i")).alias("text"))
    v0 = voice.filter("t0 <= 1.0").select(K).distinct().withColumn("_v", F.lit(True))
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"(?U)\S+")))
    d = videos.select(K).join(shots.select(K).distinct(), K, "left_semi").join(h, K, "left").join(v0, K, "left").withColumn("_w", words)
    ok = (F.col("text").isNotNull() | F.col("_v").isNotNull()) & (F.col("_w") <= most)
    return _row(d, "hook", _pf(ok, "warn"), F.col("_w"), F.when(F.col("text").isNotNull(), _fmt("opening text of %d word(s)", "_w")).when(F.col("_v"), "the voice opens by 1.0 s").otherwise("nothing on screen or said in the first second")).unionByName(_no_shots(videos, shots, "hook"))


def gt_sizes(videos):
    mb = F.col("file_bytes") / 1e6
    a = _row(videos, "preview_size", F.when(F.col("preview_mb").isNull(), "skip").otherwise(_pf(F.col("preview_mb") <= LIMITS["max_preview_mb"])), F.col("preview_mb"), _fmt("%.1f MB", "preview_mb"))
    return a.unionByName(_row(videos, "file_size", _pf(mb <= LIMITS["max_mb"]), mb, _fmt("%.1f MB", mb)))


def roll_up(checks):
    """ok, failed and warned checks per video."""
    names = lambda s: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("status") == s, F.col("check")))))
    return checks.groupBy(K).agg((F.count_if(F.col("status") == "fail") == 0).alias("ok"), names("fail").alias("failed"), names("warn").alias("warnings"), names("skip").alias("skipped"))


def all_checks(videos, shots, caps, words, voice, script, samples, heard, frames, blacks, silences, cuts=None):
    """Every check over inputs that are worked out once and written by video: each is exchanged once, and all joins and
    aggregations of the checks find a video's rows in one place."""
    videos, shots, caps, words, voice, script, samples, heard, frames, blacks, silences = (written_by(d, K) for d in (
        videos, shots, caps, words, voice, script, samples, heard, frames, blacks, silences))
    cuts = cuts if cuts is None else written_by(cuts, K)
    parts = [gt_audio_track(videos), gt_duration(videos), gt_black_frames(videos, blacks), gt_silence(videos, silences), gt_peak(videos), gt_voice_audible(videos, script, samples, heard),
             gt_text_sync(videos, caps, voice, script), gt_text_cut(videos, caps, shots), gt_voice_image(videos, shots, words), gt_ending(videos, shots, caps, voice, frames, blacks, cuts),
             gt_renewal(videos, shots, caps, voice), gt_picture_with_voice(videos, shots, voice), gt_pace(videos, shots), gt_hook(videos, shots, caps, voice), gt_sizes(videos)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
