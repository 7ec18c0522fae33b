"""Timelines of rendered videos: cuts, windows, and text, voice and picture against each other."""
from pyspark.sql import Window, functions as F

from framelake.functions.core import c, exact_sum, let, py_round
from framelake.operators.text import pauses_around, token_array
from framelake.plans.ranges import no_overlap, overlap_join
from framelake.plans.similarity import written_once

V = "video_id"


# ---- timelines -------------------------------------------------------------------------------
TIMELINE = ("struct<duration:double,fade_out:double,loop:boolean,shots:array<struct<i:int,t0:double,t1:double,dur:double,src:string,hero:boolean,says:variant>>,"
            "captions:array<struct<t0:double,t1:double,text:string,source:string,audio_t0:double>>,words:array<struct<t0:double,t1:double,text:string>>,voice:array<array<double>>>")


def phrases(says):
    """The phrases a shot promises: a timeline states one text or a list of them."""
    v = F.col(says)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<string>")).when(v.isNotNull() & ~F.is_variant_null(v), F.array(v.cast("string")))


def read_timelines(docs, key=V, body="body"):
    """Timeline sidecars -> (shots, captions, words, voice windows)."""
    d = docs.select(key, F.from_json(body, TIMELINE).alias("d")).filter("d.shots is not null")
    shots = d.select(key, F.explode("d.shots").alias("x")).select(key, "x.*").withColumn("says", phrases("says"))
    caps = d.select(key, F.posexplode("d.captions").alias("i", "x")).select(key, "i", "x.*")
    words = d.select(key, F.posexplode("d.words").alias("i", "x")).select(key, "i", "x.*")
    voice = d.select(key, F.posexplode("d.voice").alias("i", "x")).select(key, "i", F.col("x")[0].alias("t0"), F.col("x")[1].alias("t1"))
    return shots, caps, words, voice


def timeline_from_spec(segments, key=V):
    """segments(key, i, dur or beats, bpm, beat0, src): cut times worked out, flagged partial. A video
    with a segment that has no length gets no timeline."""
    d = F.when(F.col("beats").isNotNull(), F.col("beats") * (60.0 / F.col("bpm"))).otherwise(F.col("dur"))
    w = Window.partitionBy(key).orderBy("i")
    s = segments.withColumn("_d", d).withColumn("_bad", F.max(F.col("_d").isNull()).over(Window.partitionBy(key))).filter("not _bad")
    t0 = F.coalesce("beat0", F.lit(0.0)) + F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return s.withColumn("_t", t0).select(key, "i", py_round("_t", 3).alias("t0"), py_round(F.col("_t") + F.col("_d"), 3).alias("t1"), py_round("_d", 3).alias("dur"),
                                         F.element_at(F.split(F.coalesce("src", F.lit("")), "/"), -1).alias("src"), F.lit(True).alias("partial"))


def anchor_captions(caps, shots, key=V):
    """Captions tied to a shot or a range of shots (negative counts from the end) get their seconds;
    a bad index or an empty window is an error row."""
    n = shots.groupBy(key).agg(F.count("*").alias("_n"))
    at = lambda x: F.when(F.col(x) < 0, F.col(x) + F.col("_n")).otherwise(F.col(x))
    j = caps.join(n, key, "left").withColumn("_a", at("seg_from")).withColumn("_b", at("seg_to"))
    a = shots.select(key, F.col("i").alias("_a"), F.col("t0").alias("_s0"))
    b = shots.select(key, F.col("i").alias("_b"), F.col("t1").alias("_s1"))
    j = j.join(a, [key, "_a"], "left").join(b, [key, "_b"], "left")
    t0 = F.when(F.col("seg_from").isNotNull(), F.col("_s0") + F.coalesce("lead", F.lit(0.0))).otherwise(F.col("t0"))
    t1 = F.when(F.col("seg_from").isNotNull(), F.col("_s1") + F.coalesce("tail", F.lit(0.0))).otherwise(F.col("t1"))
    j = j.withColumn("t0", t0).withColumn("t1", t1)
    err = (F.when(F.col("seg_from").isNotNull() & (F.col("_s0").isNull() | F.col("_s1").isNull()), "no such segment")
           .when(F.col("t0").isNull() | F.col("t1").isNull(), "neither seconds nor segment").when(F.col("t1") <= F.col("t0"), "ends before it starts"))
    return j.withColumn("error", err).drop("_n", "_a", "_b", "_s0", "_s1")


def captions_from_spec(caps, segments, key=V):
    """Captions that a spec spells out, on its own worked-out timeline; source says whether seconds come from a cut or are
    stated. A caption without both ends (one tied to a segment that is not there, too; anchor_captions names those) and the
    captions of a video without a timeline are left out."""
    shots = timeline_from_spec(segments, key)
    known = caps.join(shots.select(key).distinct(), key, "left_semi")
    return (anchor_captions(known, shots, key).filter("t0 IS NOT NULL AND t1 IS NOT NULL")
            .withColumn("source", F.when(F.col("seg_from").isNotNull(), "cut").otherwise("spec")).drop("error"))


def segment_subtitles(subs, segs, min_dur=0.7):
    """Subtitles of a clip in the time of the cut that shows it; slivers under 0.2 s are dropped."""
    j = segs.join(subs.select("src", "sub", F.col("t0").alias("_s0"), F.col("t1").alias("_s1"), "text"), "src")
    t0 = F.greatest("g0", F.col("g0") + (F.col("_s0") - F.col("start_s")) / F.col("speed"))
    t1 = F.least("g1", F.col("g0") + (F.col("_s1") - F.col("start_s")) / F.col("speed"))
    j = j.withColumn("t0", t0).withColumn("t1", t1).filter(F.col("t1") - F.col("t0") >= 0.2)
    return j.withColumn("t1", F.least("g1", F.greatest("t1", F.col("t0") + min_dur))).drop("_s0", "_s1")


def unify_look(shots, key=V):
    """One look for the day shots of a video and one for the night shots, voted by length."""
    # Looks of the night.
    side = F.when(F.col("look").isin("night-city", "neon-night"), "night").otherwise("day")
    s = shots.withColumn("side", side)
    vote = s.groupBy(key, "side", "look").agg(F.sum("dur").alias("w"), F.min("i").alias("f"))
    win = vote.groupBy(key, "side").agg(F.max_by("look", F.struct(py_round("w", 6).alias("w"), (-F.col("f")).alias("f"))).alias("winner"))
    return s.join(win, [key, "side"]).withColumn("look", F.col("winner")).drop("winner")


# ---- windows ---------------------------------------------------------------------------------
def _last_end(keys, s, e):
    w = Window.partitionBy(*keys).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(e).over(w)


def merge_windows(win, tol, keys=(V,), total=None, lead=0.0, tail=0.0):
    """Windows with their margins; those closer than tol become one."""
    a = F.greatest(F.lit(0.0), F.col("t0") - lead)
    b = F.col("t1") + tail
    b = F.least(b, F.col(total)) if total else b
    w = win.withColumn("_a", a).withColumn("_b", b)
    w = w.withColumn("_p", _last_end(keys, "_a", "_b")).withColumn("_n", F.coalesce((F.col("_a") - F.col("_p") > tol).cast("int"), F.lit(1)))
    w = w.withColumn("window", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, 0)))
    return w.groupBy(*keys, "window").agg(py_round(F.min("_a"), 3).alias("t0"), py_round(F.max("_b"), 3).alias("t1")).filter("t1 > t0")


def complement(win, totals, keys=(V,), total="total_s", min_gap=1.0, pad=0.4):
    """Stretches no window covers, longer than min_gap and pulled in by pad, with the one at the end."""
    w = win.withColumn("_p", F.coalesce(_last_end(keys, "t0", "t1"), F.lit(0.0)))
    gaps = w.filter(F.col("t0") - F.col("_p") > min_gap).select(*keys, (F.col("_p") + pad).alias("g0"), (F.col("t0") - pad).alias("g1"))
    end = totals.join(win.groupBy(*keys).agg(F.max("t1").alias("_e")), list(keys), "left").withColumn("_e", F.greatest(F.lit(0.0), F.coalesce("_e", F.lit(0.0))))
    last = end.filter(F.col(total) - F.col("_e") > min_gap).select(*keys, (F.col("_e") + pad).alias("g0"), (F.col(total) - pad).alias("g1"))
    return gaps.unionByName(last)


def clear_band(blocked, keys, margin=0.0):
    """Tallest free band of a frame given the blocked bands (t0, t1 in shares of the height)."""
    one = blocked.select(*keys).distinct().withColumn("total_s", F.lit(1.0))
    free = complement(blocked.withColumn("t0", F.greatest(F.lit(0.0), "t0")).withColumn("t1", F.least(F.lit(1.0), "t1")), one, keys, min_gap=0.0, pad=0.0)
    return free.groupBy(*keys).agg(py_round(F.max(F.col("g1") - F.col("g0")), 3).alias("clear_band"))


def pair_silences(events, totals, keys=(V,), shortest=0.6, tail_s=1.0):
    """Start and end rows in order become gaps; a last start runs to the end. Tail and short ones drop."""
    w = Window.partitionBy(*keys).orderBy("t", "kind")
    e = events.join(totals, list(keys)).withColumn("_k", F.lag("kind").over(w)).withColumn("_t", F.greatest(F.lit(0.0), F.lag("t").over(w))).withColumn("_nx", F.lead("kind").over(w))
    tail = F.greatest(F.lit(0.0), F.col("total_s") - tail_s)
    closed = e.filter((F.col("kind") == "end") & (F.col("_k") == "start") & (F.col("t") - F.col("_t") >= shortest) & (F.col("_t") < tail)).select(*keys, F.col("_t").alias("s0"), F.col("t").alias("s1"))
    open_ = e.filter((F.col("kind") == "start") & F.col("_nx").isNull() & (F.greatest(F.lit(0.0), F.col("t")) < tail)).select(*keys, F.greatest(F.lit(0.0), F.col("t")).alias("s0"), F.col("total_s").alias("s1"))
    return closed.unionByName(open_)


def silence_phrases(silences, totals, keys=(V,), total="total_s", shortest=0.25):
    """Without a transcript, phrases are what lies between silences (s0, s1), numbered, with the pauses around them."""
    spans = complement(silences.select(*keys, F.col("s0").alias("t0"), F.col("s1").alias("t1")), totals, keys, total, shortest, 0.0)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("g0")) - 1
    ph = spans.select(*keys, number.alias("phrase"), py_round("g0", 3).alias("start"), py_round("g1", 3).alias("end"), py_round(F.col("g1") - F.col("g0"), 3).alias("dur"))
    return pauses_around(ph, list(keys))


def sample_plan(clips, cuts, key=V):
    """Seconds to look at: a grid by length, the last frame, and the middle of every shot the grid misses."""
    step = F.when(F.col("dur") <= 35, 0.5).when(F.col("dur") <= 100, 1.0).otherwise(2.0)
    k = clips.withColumn("step", step).withColumn("last", F.greatest(F.lit(0.0), F.col("dur") - 1.0 / F.col("fps"))).withColumn("_m", F.floor(F.col("last") / F.col("step")))
    grid = k.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_i"), "step").select(key, py_round(F.col("_i") * F.col("step"), 2).alias("t"))
    end = k.filter(F.col("last") - F.col("_m") * F.col("step") > 0.05).select(key, py_round("last", 2).alias("t"))
    b = cuts.select(key, F.col("t0").alias("a"), F.col("t1").alias("b")).join(k.select(key, "step", "last", "_m"), key)
    # a grid time inside [a, b) exists iff the first multiple of step at or after a is below b
    nxt = F.ceil(py_round(F.col("a") / F.col("step"), 9))
    covered = ((nxt <= F.col("_m")) & (nxt * F.col("step") < F.col("b"))) | ((F.col("last") - F.col("_m") * F.col("step") > 0.05) & (py_round("last", 2) >= F.col("a")) & (py_round("last", 2) < F.col("b")))
    mids = b.filter(~covered).select(key, F.least(py_round((F.col("a") + F.col("b")) / 2, 2), F.col("last")).alias("t"))
    return grid.unionByName(end).unionByName(mids).distinct()


# ---- the cut grid ----------------------------------------------------------------------------
def cut_grid(shots, music, key="variant_id", lead=0.14, tail=0.30, close_hold=0.95):
    """Cut times on an absolute grid anchored at the first beat. A narrated shot lasts its line; the cut
    then snaps to the next half beat. Every cut needs the one before, so a variant is folded in order."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "beats", "dur", "line", "line_s"))), lambda s: s)
    v = shots.groupBy(key).agg(arr.alias("s")).join(music.select(key, "bpm", "beat0"), key, "left")
    v = v.withColumn("beat", F.when(F.col("bpm") > 0, 60.0 / F.col("bpm"))).withColumn("beat0", F.coalesce("beat0", F.lit(0.0))).withColumn("n", F.size("s"))
    row = "struct<i:int,t0:double,t1:double,voice_at:double,line:int>"
    beat, b0, n = F.col("beat"), F.col("beat0"), F.col("n")
    snap = lambda t, unit: b0 + F.ceil((t - b0) / unit - 1e-6) * unit

    def step(a, s):
        t = a["t"]
        first, last = s["i"] == 0, s["i"] == n - 1
        lead_in = F.when(first, 0.0).otherwise(lead)
        need = lead_in + s["line_s"] + F.when(last, close_hold).otherwise(tail)
        spoken = F.coalesce(t + s["dur"], F.when(beat.isNotNull(), snap(t + need, beat / 2)).otherwise(t + need))
        plain = F.when(beat.isNotNull() & s["beats"].isNotNull(), F.when(first, b0 + s["beats"] * beat).otherwise(snap(t, beat) + s["beats"] * beat)).otherwise(t + s["dur"])
        t1 = F.when(s["line"].isNotNull(), spoken).otherwise(plain)
        at = F.when(s["line"].isNotNull(), t + lead_in)
        return let(t1, lambda e: F.struct(e.alias("t"), F.array_append(a["rows"], F.struct(s["i"].alias("i"), py_round(t, 4).alias("t0"), py_round(e, 4).alias("t1"), at.alias("voice_at"), s["line"].alias("line"))).alias("rows")))
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast(f"array<{row}>").alias("rows"))
    return v.select(key, F.explode(F.aggregate("s", start, step, lambda a: a["rows"])).alias("r")).select(key, "r.*").withColumn("dur", py_round(F.col("t1") - F.col("t0"), 4))


def split_long(grid, music=None, max_shot=2.6, key="variant_id"):
    """Long holds become equal pieces of the same take (half-beat snapped), alternating a closer framing;
    the line stays on the first piece. Adds the new index, its source start and the old index."""
    g = grid.join(music.select(key, "bpm", "beat0"), key, "left") if music is not None else grid.withColumn("bpm", F.lit(None).cast("double")).withColumn("beat0", F.lit(0.0))
    ok = (F.col("dur") > max_shot * 1.15) & F.col("splittable") & ~F.coalesce("hero", F.lit(False))
    k = F.when(ok, F.ceil(F.col("dur") / max_shot)).otherwise(1).cast("int")
    half = 30.0 / F.col("bpm")
    inner = F.transform(F.sequence(F.lit(0), F.col("_k")), lambda j: F.when(j == 0, F.col("t0")).when(j == F.col("_k"), F.col("t1")).otherwise(
        F.when((F.col("bpm") > 0), F.col("beat0") + F.bround((F.col("t0") + F.col("dur") * j / F.col("_k") - F.col("beat0")) / half, 0) * half).otherwise(F.col("t0") + F.col("dur") * j / F.col("_k"))))
    g = g.withColumn("_k", k).withColumn("_b", inner)
    tight = (F.col("bpm") > 0) & (F.col("_k") > 1) & F.exists(F.sequence(F.lit(1), F.col("_k")), lambda j: F.get("_b", j) - F.get("_b", j - 1) < 0.5)
    g = g.withColumn("_b", F.when(F.coalesce(tight, F.lit(False)), F.array("t0", "t1")).otherwise(F.col("_b"))).withColumn("_k", F.size("_b") - 1)
    p = g.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("piece"))
    a, b = py_round(F.get("_b", F.col("piece")), 4), py_round(F.get("_b", F.col("piece") + 1), 4)
    w = Window.partitionBy(key).orderBy("i", "piece")
    speed = F.coalesce("speed", F.lit(1.0)) if "speed" in grid.columns else F.lit(1.0)
    return p.select(key, (F.row_number().over(w) - 1).alias("new_i"), F.col("i").alias("old_i"), "piece", a.alias("p0"), b.alias("p1"), py_round(b - a, 4).alias("dur"),
                    F.when(F.col("piece") % 2 == 1, 1.22).otherwise(1.0).alias("zoom"), py_round(F.col("start_s") + (F.get("_b", F.col("piece")) - F.col("t0")) * speed, 3).alias("start_s"),
                    F.when(F.col("piece") == 0, F.col("line")).alias("line"))


def remap_captions(caps, pieces, key="variant_id"):
    """Caption indexes after the split: each points at the first piece of its old shot."""
    m = pieces.filter("piece = 0").select(key, F.col("old_i").alias("seg"), F.col("new_i").alias("_n"))
    return caps.join(m, [key, "seg"], "left").withColumn("seg", F.coalesce("_n", "seg")).drop("_n")


# ---- pace ------------------------------------------------------------------------------------
def _variation(items):
    """Standard deviation over mean of the lengths in items(i, dur), folded in the order of the shots: the last bit, and with it
    a value that lies on a limit, does not depend on how rows arrive."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(a, x):
        d = x - a["mean"]
        m = a["mean"] + d / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), (a["total"] + x).alias("total"), m.alias("mean"), (a["sq"] + (x - m) * d).alias("sq"))
    known = F.filter(F.transform(F.array_sort(items), lambda x: x["dur"]), lambda x: x.isNotNull())
    return F.aggregate(known, zero, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["sq"] / a["n"]) / (a["total"] / a["n"])))


def pacing(shots, totals, key=V):
    s = shots.join(totals, key)
    third = lambda k: F.count_if((F.col("t0") >= F.col("total_s") * k / 3) & (F.col("t0") < F.col("total_s") * (k + 1) / 3))
    return s.groupBy(key).agg(F.count("*").alias("shots"), (exact_sum("dur", 6) / F.count("*")).alias("mean"), F.median("dur").alias("median"), F.min_by("dur", "i").alias("first"), F.max("dur").alias("longest"),
                              third(0).alias("third1"), third(1).alias("third2"), third(2).alias("third3"), _variation(F.collect_list(F.struct("i", F.col("dur").cast("double").alias("dur")))).alias("cv"))


def speech_share(segs, totals, key=V):
    s = segs.groupBy(key).agg(exact_sum(F.col("t1") - F.col("t0"), 6).alias("speech_s"), F.min("t0").alias("starts_at"))
    return totals.join(s, key, "left").select(key, py_round(F.coalesce("speech_s", F.lit(0.0)), 1).alias("seconds"),
                                              F.when(F.col("total_s") > 0, py_round(F.coalesce("speech_s", F.lit(0.0)) / F.col("total_s"), 2)).otherwise(0.0).alias("share"), "starts_at")


# ---- text, voice and picture -----------------------------------------------------------------
def text_cut(caps, shots, tol=0.35, key=V):
    """Text with no voice behind it that is still there after its shot is gone."""
    w = Window.partitionBy(key)
    b = shots.withColumn("_last", F.max("i").over(w)).filter("i < _last").select(key, F.col("t1").alias("cut"))
    free = caps.filter(F.col("audio_t0").isNull() & F.coalesce("source", F.lit("spec")).isin("spec")).filter("t1 - t0 > 0.3")
    j = overlap_join(free.select(key, "i", "t0", "t1"), b, [key], ("t0 + 0.15", "t1 - 0.15"), ("cut", "cut"), 4.0)
    j = j.filter((F.col("cut") > F.col("t0") + 0.15) & (F.col("cut") < F.col("t1") - 0.15))
    return j.groupBy(key, "i", "t1").agg(F.min("cut").alias("cut")).filter(F.col("t1") - F.col("cut") > tol).select(key, "i", "cut", py_round(F.col("t1") - F.col("cut"), 3).alias("holds_s"))


def voice_image(shots, words, tol=0.25, key=V):
    """Each phrase that a shot promises (says: a list of texts) against when the voice says it first, as whole tokens in a row:
    (key, i, k, status, said_at), k counting the shot's phrases."""
    flat = words.select(key, "n", "t0", "t1", F.posexplode(token_array("text", "phrase")).alias("k", "token"))
    pos = flat.select(key, "t0", "t1", "token", F.row_number().over(Window.partitionBy(key).orderBy("n", "k")).alias("p"))
    promised = shots.select(key, "i", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.posexplode("says").alias("k", "phrase"))
    want = promised.withColumn("w", token_array("phrase", "phrase")).filter(F.size("w") > 0).drop("phrase")
    each = want.select(key, "i", "k", F.size("w").alias("m"), F.posexplode("w").alias("o", "token"))
    hit = (each.join(pos, [key, "token"]).withColumn("at", F.col("p") - F.col("o")).groupBy(key, "i", "k", "m", "at")
           .agg(F.count("*").alias("_c"), F.min(F.when(F.col("o") == 0, F.col("t0"))).alias("v0"), F.max(F.when(F.col("o") == F.col("m") - 1, F.col("t1"))).alias("v1")).filter("_c = m"))
    first = hit.groupBy(key, "i", "k").agg(F.min(F.struct("at", "v0", "v1")).alias("h"))
    r = want.join(first, [key, "i", "k"], "left")
    status = (F.when(F.col("h").isNull(), "never said").when((F.col("h.v1") < F.col("s0") - tol) | (F.col("h.v0") > F.col("s1") + tol), "off screen").otherwise("ok"))
    return r.select(key, "i", "k", status.alias("status"), F.col("h.v0").alias("said_at"))


def recall(lines, heard, key=V, before=0.8, after=1.2):
    """Share of a line's words heard inside its window, each written word counted."""
    want = lines.select(key, "i", "w0", "w1", F.posexplode(token_array("text")).alias("k", "token"))
    got = heard.select(key, F.explode(token_array("text")).alias("token"), F.col("t0").alias("h0"))
    j = (want.alias("a").join(got.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.token") == F.col("b.token"))
                              & (F.col("h0") >= F.col("w0") - before) & (F.col("h0") <= F.col("w1") + after), "left_semi"))
    n = j.groupBy(key, "i").agg(F.count("*").alias("_g"))
    all_ = lines.select(key, "i", F.size(token_array("text")).alias("_w"))
    return all_.join(n, [key, "i"], "left").select(key, "i", F.when(F.col("_w") == 0, 1.0).otherwise(F.coalesce("_g", F.lit(0)) / F.col("_w")).alias("recall"))


def speech_windows(lines, totals, key=V):
    """Where each line is measured: its own length when the script says it, else 2.5 s, up to the next line."""
    w = Window.partitionBy(key).orderBy("i")
    span = F.when(F.coalesce("duration_s", F.lit(0.0)) != 0, F.col("duration_s") - 0.1).otherwise(2.5)
    d = lines.join(totals, key).withColumn("_nx", F.lead("start_s").over(w))
    end = F.least(F.coalesce(F.col("_nx") - 0.2, F.lit(1e12)), F.col("start_s") + span)
    return d.select(key, "i", "start_s", "text", (F.col("start_s") + 0.15).alias("w0"), F.least("total_s", F.greatest(F.col("start_s") + 0.6, end)).alias("w1"), "total_s")


def span_levels(spans, samples, keys, s, e, key=V, width=8.0):
    """Mean level of the samples inside each span."""
    j = overlap_join(spans, samples.select(key, F.col("t").alias("_st"), "db"), [key], (s, e), ("_st", "_st"), width)
    return j.groupBy(key, *keys, s, e).agg(F.avg("db").alias("level"))


def voice_levels(lines, samples, totals, key=V, reach=10.0, win=None):
    """Each line's level against the two nearest quiet stretches within ten seconds. Samples, of which there are most, meet lines
    and stretches in one join; windows and levels, a row for each, are written, as both are read more than once. win: the
    written windows of the lines (speech_windows), where the caller has them."""
    win = written_once(speech_windows(lines, totals, key)) if win is None else win
    gaps = complement(win.select(key, F.col("w0").alias("t0"), F.col("w1").alias("t1")), totals, (key,), "total_s", 1.0, 0.4)
    last = win.groupBy(key).agg(F.max("w1").alias("_le"))
    gaps = gaps.join(last, key).filter((F.col("g0") < F.col("_le")) & (F.col("g1") - F.col("g0") > 0.05))
    spans = (win.select(key, "i", F.lit(True).alias("_line"), F.col("w0").alias("s0"), F.col("w1").alias("s1"))
             .unionAll(gaps.select(key, F.lit(None).cast(win.schema["i"].dataType), F.lit(False), "g0", "g1")))
    levels = written_once(span_levels(spans, samples, ["i", "_line"], "s0", "s1", key))
    gl = levels.filter("NOT _line").select(key, F.col("s0").alias("g0"), F.col("s1").alias("g1"), F.col("level").alias("bg"))
    lv = levels.filter("_line").select(key, "i", F.col("s0").alias("w0"), F.col("s1").alias("w1"), "level")
    near = overlap_join(lv, gl, [key], (f"w0 - {reach}", f"w1 + {reach}"), ("g0", "g1"), 2 * reach, how="left")
    d = F.least(F.abs(F.col("g0") - F.col("w1")), F.abs(F.col("g1") - F.col("w0")))
    # the stretches within reach of a line are few; the two nearest are kept
    two = F.slice(F.array_sort(F.collect_list(F.when(F.col("bg").isNotNull(), F.struct(d.alias("d"), "bg", "g0")))), 1, 2)
    r = near.groupBy(key, "i", "w0", "w1", "level").agg(two.alias("_two"))
    mean = F.aggregate("_two", F.lit(0.0), lambda a, x: a + x["bg"]) / F.nullif(F.size("_two"), F.lit(0))
    return r.select(key, "i", "w0", "w1", "level", mean.alias("background"))


def weak_lines(levels, margin=4.0):
    why = F.when(F.col("level") < -45, "silent").when(F.col("level") - F.col("background") < margin, "under the background")
    return levels.withColumn("weak", why)


def line_openers(lines, caps, key=V):
    """The first caption that is a prefix of the script line."""
    cw = caps.select(key, F.col("i").alias("cap"), F.col("t0").alias("cap_t0"), token_array("text", "phrase").alias("cw")).filter(F.size("cw") > 0).withColumn("_h", F.col("cw")[0])
    lw = lines.select(key, "i", "start_s", token_array("text", "phrase").alias("lw")).filter(F.size("lw") > 0).withColumn("_h", F.col("lw")[0])
    j = lw.join(cw, [key, "_h"]).filter(F.slice("lw", F.lit(1), F.size("cw")) == F.col("cw"))
    o = F.min(F.struct("cap_t0", "cap"))
    return j.groupBy(key, "i", "start_s").agg(o.alias("c")).select(key, "i", "start_s", "c.cap", "c.cap_t0")


def talk_in_shot(shots, voice, key=V):
    """Seconds of speech under each shot."""
    j = overlap_join(shots.select(key, "i", "t0", "t1"), voice.select(key, F.col("t0").alias("v0"), F.col("t1").alias("v1")), [key], ("t0", "t1"), ("v0", "v1"), 6.0)
    t = j.groupBy(key, "i").agg(F.sum(F.greatest(F.lit(0.0), F.least("t1", "v1") - F.greatest("t0", "v0"))).alias("_t"))
    return shots.join(t, [key, "i"], "left").withColumn("talk_s", F.coalesce("_t", F.lit(0.0))).drop("_t")


def renewal(shots, caps, voice, totals, key=V):
    """Longest stretch with nothing new: no cut, no text, no voice line. A stretch held whole by one hero
    shot is excused."""
    ev = (shots.select(key, py_round("t0", 2).alias("t")).unionByName(caps.select(key, py_round("t0", 2).alias("t"))).unionByName(voice.select(key, py_round("t0", 2).alias("t"))).distinct())
    end = totals.select(key, "total_s")
    has = shots.select(key).distinct()
    ev = ev.join(end, key).filter(F.col("t") < F.col("total_s") - 1.0).select(key, "t", F.lit(0).alias("z")).unionByName(
        end.join(has, key, "left_semi").select(key, F.greatest(F.lit(0.0), F.col("total_s") - 1.0).alias("t"), F.lit(1).alias("z")))
    ev = written_once(ev.withColumn("nx", F.lead("t").over(Window.partitionBy(key).orderBy("t", "z"))).filter("nx is not null"))      # read twice
    hero = shots.filter("hero").select(key, F.col("t0").alias("h0"), F.col("t1").alias("h1"))
    held = overlap_join(ev.select(key, "t", "nx"), hero, [key], ("t", "nx"), ("h0 - 0.02", "h1 + 0.02"), 6.0).filter((F.col("h0") <= F.col("t") + 0.01) & (F.col("h1") >= F.col("nx") - 0.01)).select(key, "t", "nx").distinct()
    gap = ev.join(held, [key, "t", "nx"], "left_anti").withColumn("stale", F.col("nx") - F.col("t")).filter("stale > 0")
    worst = gap.groupBy(key).agg(F.max(F.struct("stale", (-F.col("t")).alias("_n"))).alias("w"))
    return has.join(worst, key, "left").select(key, F.coalesce("w.stale", F.lit(0.0)).alias("stale_s"), F.coalesce(-F.col("w._n"), F.lit(0.0)).alias("at_s"))


# ---- the end of the picture ------------------------------------------------------------------
def fade(frames, totals, key=V, hint=None):
    """Trailing run of frames that brightens backwards up to 85 % of the middle brightness: (key, total_s, fade_s)."""
    # a fade is shorter than three seconds: only those frames, and the one before them, are kept, and the run is read in their row
    seen = F.struct(F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    cut = F.col("total_s") - 3.0
    n = frames.join(totals.select(key, "total_s"), key).groupBy(key, "total_s").agg(
        F.count("*").alias("_n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y DESC)").alias("typical"),
        F.collect_list(F.when(F.col("t") >= cut, seen)).alias("_late"), F.max(F.when(F.col("t") < cut, seen)).alias("_p"))
    back = F.reverse(F.array_sort(F.concat("_late", F.array_compact(F.array("_p")))))
    start = F.struct(F.lit(True).alias("on"), F.lit(False).alias("top"), F.lit(None).cast("double").alias("prev"), F.lit(None).cast("double").alias("from_s"))

    def step(a, x):
        on = a["on"] & ~a["top"] & x["y"].isNotNull() & ~F.coalesce(x["y"] < a["prev"] - 1.0, F.lit(False))
        return F.struct(on.alias("on"), F.coalesce(x["y"] >= F.col("typical") * 0.85, F.lit(False)).alias("top"), x["y"].alias("prev"), F.when(on, x["t"]).otherwise(a["from_s"]).alias("from_s"))
    r = n.filter("_n >= 12").withColumn("_back", back)
    r = r.withColumn("from_s", F.aggregate("_back", start, step, lambda a: a["from_s"])).withColumn("last_y", F.get("_back", F.lit(0))["y"])
    ok = (F.col("last_y") < F.greatest(F.lit(2.0), F.col("typical") * 0.5)) & (F.col("total_s") - F.col("from_s") < F.least(F.lit(3.0), F.col("total_s") / 3))
    return r.select(key, "total_s", F.when(ok, py_round(F.col("total_s") - F.col("from_s"), 3)).otherwise(0.0).alias("fade_s"))


def end_motion(frames, fades, totals, key=V, tail_s=0.5):
    """Motion of the last half second over the middle motion of the body, both before the fade."""
    f = frames.join(fades if "total_s" in fades.columns else fades.join(totals, key), key)
    end = F.when(F.col("fade_s") > 0.05, F.col("total_s") - F.col("fade_s") - 0.1).otherwise(F.col("total_s"))
    f = f.withColumn("_e", end)
    f = f.withColumn("_body", F.when((F.col("t") > 0.5) & (F.col("t") < F.col("_e") - tail_s - 0.1), F.col("d"))).withColumn("_tail", F.when((F.col("t") >= F.col("_e") - tail_s) & (F.col("t") < F.col("_e")), F.col("d")))
    r = f.groupBy(key).agg(F.max("fade_s").alias("fade_s"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _body DESC)").alias("_m"), F.avg("_tail").alias("_t"))
    return r.select(key, "fade_s", F.when(F.col("_m") >= 0.05, F.col("_t") / F.col("_m")).alias("motion"))
