"""Catalogued moments: merging, ranking, disk repair, frame and live-clip decisions."""
from pyspark.sql import Window, functions as F

from framelake.functions.core import add_note, c, let, py_round
from framelake.plans.numbering import numbered_by_range
from framelake.plans.similarity import written_once

# Emotion points, frame-check and live-clip limits.
EMOTION = {"laughter": 5, "surprise": 4, "joy": 3, "awe": 3, "tender": 3, "fear": 3, "tension": 3, "pride": 2, "none": 0}
FACE_LOW_Y, HAZE_HIGH, CONTRAST_LOW, CLEAR_MIN, BOTTOM_PEOPLE = 0.55, 0.42, 46.0, 0.55, 0.22
FPS, CAMERA_STEADY, CAMERA_SWING, SUBJECT_MIN, MIN_USABLE_S = 10, 0.10, 0.35, 0.9, 1.0
IMAGE = r"(?i)\.(jpg|jpeg|heic|png)$"
UUID = "(?i)[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}"


def in_use(x="use"):
    return F.coalesce(F.col(x), F.lit(True))


def usable(moments):
    """Not dropped, not missing, and with the human reading filled in."""
    return moments.filter(in_use() & ~F.coalesce("missing", F.lit(False)) & F.col("emotion").isNotNull())


def moment_score():
    e = F.coalesce(*[F.when(F.col("emotion") == k, v) for k, v in EMOTION.items()], F.lit(0))
    b = lambda x: F.coalesce(F.col(x).cast("int"), F.lit(0))
    return py_round(e + 2 * b("reaction") + 2 * b("real_voice") + b("candid") + F.coalesce("story_potential", F.lit(0)) + F.coalesce("hook", F.lit(0)) / 2.0 + b("favorite"), 2)


def rank_moments(moments, top=40, g=("project_id",)):
    m = usable(moments).withColumn("score", moment_score())
    w = Window.partitionBy(*g).orderBy(F.col("score").desc(), F.col("date").asc_nulls_first(), "id")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def openers(moments):
    """First-frame candidates; callers sort by date for display."""
    return moments.filter(in_use() & (F.col("hook") == 5))


def merge_batches(items, g=("project_id",)):
    """Same file and window is one moment; then same burst and description. The better one stays, the
    other is kept as dropped with the reason."""
    best = [F.col("quality").desc_nulls_last(), F.col("hook").desc_nulls_last(), F.col("id")]
    w1 = Window.partitionBy(*g, "path", "start_s", "end_s").orderBy(*best)
    a = items.withColumn("_w1", F.first("id").over(w1)).withColumn("_d1", F.col("_w1") != F.col("id"))
    # a dropped copy must not win its burst, and rows without a burst stand alone
    solo = F.when(F.col("_d1") | F.col("burst").isNull(), F.col("id"))
    w2 = Window.partitionBy(*g, "burst", "description", solo).orderBy(*best)
    b = a.withColumn("_w2", F.first("id").over(w2)).withColumn("_d2", ~F.col("_d1") & (F.col("_w2") != F.col("id")))
    return (b.withColumn("use", ~(F.col("_d1") | F.col("_d2")))
            .withColumn("reason", F.when(F.col("_d1"), F.concat(F.lit("same window as "), "_w1")).when(F.col("_d2"), F.concat(F.lit("same burst as "), "_w2")))
            .drop("_w1", "_d1", "_w2", "_d2"))


def catalog_totals(moments, g=("project_id",)):
    return moments.groupBy(*g).agg(F.count("*").alias("moments"), F.count_if(in_use() & (F.col("hook") == 5)).alias("openers"),
                                   F.count_if(in_use() & F.col("subject_present")).alias("with_subject"), F.count_if(in_use()).alias("usable"), F.count_if(~in_use()).alias("dropped"))


def coverage(planned, results, g=("project_id",)):
    """Planned batches against what came back: lost, reused and moments."""
    j = planned.join(results, [*g, "batch"], "left")
    return j.groupBy(*g).agg(F.count("*").alias("batches"), F.count_if(F.coalesce("moments", F.lit(0)) == 0).alias("lost"),
                             F.count_if(F.coalesce("reused", F.lit(False))).alias("reused"), F.coalesce(F.sum("moments"), F.lit(0)).alias("moments"))


def live_candidates(live, min_quality=3):
    return live.filter(F.col("available") & in_use() & ((F.coalesce("quality", F.lit(0)) >= min_quality) | F.coalesce("favorite", F.lit(False))))


def link_live(moments, library, lmap, g=("project_id",)):
    """Photo to its live clip by the first id known: own field, the map, the path, the notes."""
    find = lambda x: F.upper(F.nullif(F.regexp_extract(F.coalesce(c(x), F.lit("")), UUID, 0), F.lit("")))
    m = moments.join(lmap.withColumnRenamed("uuid", "_map"), [*g, "id"], "left").withColumn("uuid", F.coalesce("uuid", "_map", find("path"), find("notes"))).drop("_map")
    return m.join(library, "uuid", "left").withColumn("available", F.coalesce("live", F.lit(False)))


def base_name(x):
    return F.element_at(F.split(c(x), "/"), -1)


def file_rank(project_root):
    """Not a round's copy first, then the project's own, then the largest."""
    return [F.col("file").rlike(r"/v[0-9]+/[^/]+/resources/"), ~F.col("file").startswith(project_root), F.col("bytes").desc(), F.col("file")]


def rank_files(files, project_root, g=("project_id",)):
    f = files.withColumnRenamed("path", "file").withColumn("name", F.lower(base_name("file")))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(*g, "name").orderBy(*file_rank(project_root))))


def _fits():
    video = F.col("type").isin("video", "video360", "360") & ~F.col("file").rlike(IMAGE)
    need = F.coalesce("end_s", F.lit(0.0))
    return ~video | (need == 0) | (F.col("duration_s") >= need - 0.05)


def broken_paths(moments, files, g=("project_id",)):
    return moments.join(files.select(*g, "path"), [*g, "path"], "left_anti")


def _best_copy(broken, names, project_root, how, g):
    """The best-ranked file of the same project that fits, per broken path and window; distinct paths are few per name. A
    name that every project has meets only the files of its own project."""
    w = Window.partitionBy(*g, "path", "type", "end_s").orderBy(*file_rank(project_root))
    need = broken.select(*g, "path", "type", "end_s", "_key").distinct()
    hit = (need.join(names, [*g, "_key"]).filter(_fits()).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
           .select(*g, "path", "type", F.col("end_s").alias("_e"), F.col("file").alias("now"), F.lit(how).alias("how")))
    same = broken["end_s"].eqNullSafe(hit["_e"])
    for k in (*g, "path", "type"):
        same = same & (broken[k] == hit[k])
    return broken.join(hit, same, "left").select(broken["*"], "now", "how").drop("_key")


def repair_paths(moments, files, project_root, g=("project_id",)):
    """Broken paths repointed to a file of the same name whose length holds the window."""
    b = written_once(broken_paths(moments, files, g)).withColumn("_key", F.lower(base_name("path")))
    names = files.select(*g, F.lower(base_name("path")).alias("_key"), F.col("path").alias("file"), "bytes", "duration_s")
    return _best_copy(b, names, project_root, "same_name", g)


def name_pieces(name):
    """Substrings of a file name between separators: start or after - _, up to - _ . or the end."""
    def cut(n):
        starts = F.filter(F.sequence(F.lit(1), F.length(n)), lambda i: (i == 1) | F.substring(n, i - 1, F.lit(1)).isin("-", "_"))
        ends = F.filter(F.sequence(F.lit(1), F.length(n) + 1), lambda j: (j == F.length(n) + 1) | F.substring(n, j, F.lit(1)).isin("-", "_", "."))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: j > i), lambda j: F.substring(n, i, j - i)))))
    return let(name, cut)


def working_copies(broken, files, project_root, g=("project_id",)):
    """A copy whose name holds the stem between separators, found by equality on the pieces."""
    stem = F.lower(F.regexp_replace(base_name("path"), r"(?<=.)\.[^.]*$", ""))
    names = files.select(*g, F.explode(name_pieces(F.lower(base_name("path")))).alias("_key"), F.col("path").alias("file"), "bytes", "duration_s")
    return _best_copy(broken.withColumn("_key", stem), names, project_root, "name_contains_stem", g)


def library_fallback(missing, library, g=("project_id",)):
    """What is on no disk may still be in the project's library under its original name; the note says which."""
    lib = library.filter("not trashed").groupBy(*g, F.upper("original_name").alias("_n")).agg(F.max("uuid").alias("uuid"))
    j = missing.withColumn("_n", F.upper(base_name("path"))).join(lib, [*g, "_n"], "left").drop("_n")
    note = F.concat(F.lit("file_state="), F.coalesce(F.concat(F.lit("library:"), "uuid"), F.lit("lost")))
    return j.withColumn("missing", F.lit(True)).withColumn("notes", add_note("notes", note, "file_state="))


def sheet_index(items, per_sheet, g=("project_id",), order=("date", "id")):
    """Number, page and cell of each thumbnail of a project."""
    n = numbered_by_range(items, list(g), list(order), "n")
    return n.withColumn("page", (F.floor((F.col("n") - 1) / per_sheet) + 1).cast("int")).withColumn("cell", ((F.col("n") - 1) % per_sheet).cast("int"))


def veto(moments, index, numbers, g=("project_id",)):
    struck = index.join(numbers, [*g, "n"], "left_semi").select(*g, "id", F.lit(True).alias("_v")).distinct()
    j = moments.join(struck, [*g, "id"], "left")
    note = F.btrim(F.concat(F.rtrim(F.coalesce("notes", F.lit(""))), F.lit(" | struck_on_sheet")), F.lit(" |"))
    return j.withColumn("use", F.when(F.col("_v"), False).otherwise(F.col("use"))).withColumn("notes", F.when(F.col("_v"), note).otherwise(F.col("notes"))).drop("_v")


def check_ids(used, moments, g=("project_id",)):
    """Ids that are not in the catalogue, and ids that are there but dropped."""
    known = moments.groupBy(*g, "id").agg(F.max(in_use()).alias("_ok"))
    j = used.join(known, [*g, "id"], "left")
    return j.filter(F.col("_ok").isNull() | ~F.col("_ok")).withColumn("problem", F.when(F.col("_ok").isNull(), "not in the catalogue").otherwise("dropped")).drop("_ok")


def out_of_window(cuts, moments, g=("project_id",)):
    m = moments.select(*g, "id", "start_s", "end_s")
    return cuts.join(m, [*g, "id"]).filter((F.col("cut_start") < F.col("start_s") - 1e-9) | (F.col("cut_end") > F.col("end_s") + 1e-9))


def repeat_framings(moments, degrees=90, g=("project_id",)):
    """Framings of one full-sphere clip closer than the angle to the next one round the circle.
    Neighbours on the circle decide: some pair is too close exactly when some neighbours are."""
    k = [*g, "path"]
    m = moments.filter(in_use() & F.col("type").isin("360", "video360") & F.col("yaw").isNotNull()).withColumn("_y", F.pmod(F.col("yaw"), F.lit(360.0)))
    w = Window.partitionBy(*k).orderBy("_y", "id")
    first = F.min(F.struct("_y", "id")).over(Window.partitionBy(*k))
    nxt = F.coalesce(F.lead(F.struct("_y", "id")).over(w), first)
    d = let(F.abs(F.col("_n._y") - F.col("_y")), lambda x: F.least(x, 360 - x))
    return (m.withColumn("_n", nxt).withColumn("apart", d).filter((F.col("_n.id") != F.col("id")) & (F.col("apart") < degrees))
            .select(*k, "id", F.col("_n.id").alias("next_id"), F.round("apart", 3).alias("apart")))


def window_conflicts(moments, g=("project_id",), shortest=0.8):
    """Inverted, too short, or reaching into the file's next window."""
    m = moments.filter(in_use() & F.col("start_s").isNotNull())
    w = Window.partitionBy(*g, "path").orderBy("start_s", "id")
    nxt = F.lead(F.struct("start_s", "id")).over(w)
    span = F.col("end_s") - F.col("start_s")
    flags = F.array_compact(F.array(F.when(span <= 0, F.struct(F.lit("inverted").alias("check"), F.lit(None).cast("string").alias("other"))),
                                    F.when((span > 0) & (span < shortest), F.struct(F.lit("short").alias("check"), F.lit(None).cast("string").alias("other"))),
                                    F.when(F.col("_n.start_s") < F.coalesce("end_s", F.lit(0.0)), F.struct(F.lit("overlap").alias("check"), F.col("_n.id").alias("other")))))
    return m.withColumn("_n", nxt).withColumn("_f", F.explode(flags)).select(*g, "path", "id", "_f.check", "_f.other")


def duplicate_ids(rows, key, order, g=("project_id",)):
    """Rows whose id came before, with the previous row's position."""
    w = Window.partitionBy(*g, key).orderBy(*order)
    return rows.withColumn("earlier", F.lag(order[-1]).over(w)).filter("earlier is not null").select(*g, key, F.col(order[-1]).alias("position"), "earlier")


# ---- frame check -----------------------------------------------------------------------------
def frame_decision(m, max_edges=None):
    """obstructions[] from the numbers and one finding code per defect, private texts first. Bodies low in the frame block
    only when no face there looks at the lens. max_edges: findings of further crossing edges are left out (off: all)."""
    facing = F.exists("faces", lambda f: f["cy"] >= FACE_LOW_Y - 0.1)
    people = (F.coalesce("people_bottom", F.lit(0.0)) >= BOTTOM_PEOPLE) & (F.coalesce("people_middle", F.lit(0.0)) < F.coalesce("people_bottom", F.lit(0.0)) / 2) & ~F.coalesce(facing, F.lit(False))
    m = m.withColumn("_p", people).withColumn("_n", F.coalesce(F.size("crossing_lines"), F.lit(0)))
    fog = (F.col("haze") >= HAZE_HIGH) & (F.col("contrast") <= CONTRAST_LOW)
    line = F.col("_n") > 0
    on = lambda cond, name: F.when(cond, F.lit(name))
    obstructions = F.array_compact(F.array(on(F.col("_p"), "foreground_people"), on(line, "frame"), on(((F.col("_p") | line) & fog) | (F.col("_p") & line), "glass"), on((F.col("_p") | line) & fog, "dirt")))
    edges = F.transform(F.col("crossing_lines") if max_edges is None else F.slice("crossing_lines", 1, max_edges), lambda x: F.concat(F.when(x["axis"] == "h", "horizontal").otherwise("vertical"), F.lit("_edge")))
    private = F.transform("private_text", lambda x: F.concat(F.lit("private_"), x)) if "private_text" in m.columns else F.lit(None).cast("array<string>")
    findings = F.concat(F.coalesce(private, F.array().cast("array<string>")), F.array_compact(F.array(on(F.col("_p"), "blocking_people"))), F.coalesce(edges, F.array().cast("array<string>")),
                        F.array_compact(F.array(on((F.col("_p") | line) & fog, "dirty_glass"), on((F.col("clear_band") < CLEAR_MIN) & (F.col("_p") | (F.col("_n") > 1)), "no_clear_band"), on(F.col("_p") & line, "vehicle_window"))))
    return m.withColumn("obstructions", obstructions).withColumn("findings", findings).drop("_p", "_n")


def worst_sample(decided, key="moment_id", at="at_s"):
    """Most findings, then the least clear band, then the first sample."""
    cols = [x for x in decided.columns if x != key]
    best = F.max_by(F.struct(*cols), F.struct(F.size("findings").alias("f"), (-F.col("clear_band")).alias("b"), (-F.col(at)).alias("a")))
    return decided.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").withColumn("clean", F.size("findings") == 0)


def annotate_moments(moments, report, g=("project_id",)):
    """report(id, obstructions, findings, at_s): one note for findings of private text, one for people in the way with every
    finding and its second; each is added once, in full, and quality never changes."""
    j = moments.join(report.select(*g, "id", "obstructions", "findings", "at_s"), [*g, "id"], "left")
    private = F.filter("findings", lambda x: x.startswith("private_"))
    seen = F.concat(F.lit("frame_private="), F.array_join(private, "; "))
    look = F.concat(F.lit("frame_look="), F.array_join("findings", "; "), F.coalesce(F.concat(F.lit(" @"), F.col("at_s").cast("string")), F.lit("")))
    j = j.withColumn("notes", F.when(F.size(private) > 0, add_note("notes", seen, "frame_private=")).otherwise(F.col("notes")))
    blocked = F.array_contains("obstructions", "foreground_people")
    return j.withColumn("notes", F.when(blocked, add_note("notes", look, "frame_look=")).otherwise(F.col("notes"))).drop("obstructions", "findings", "at_s")


# ---- live clips ------------------------------------------------------------------------------
def steady_run(samples, key="clip_id"):
    """Longest run of samples below the swing limit, the earliest on ties."""
    w = Window.partitionBy(key).orderBy("i")
    s = samples.withColumn("_ok", F.col("camera") < CAMERA_SWING)
    s = s.withColumn("_g", F.sum((~F.col("_ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.filter("_ok").groupBy(key, "_g").agg(F.min("i").alias("r0"), (F.max("i") + 1).alias("r1"))
    best = runs.groupBy(key).agg(F.max_by(F.struct("r0", "r1"), F.struct((F.col("r1") - F.col("r0")).alias("n"), (-F.col("r0")).alias("a"))).alias("b"))
    return best.select(key, "b.r0", "b.r1")


def live_verdict(samples, durations=None, key="clip_id"):
    """Usable or not, and why: subject moves, slow camera, static, shaky, short."""
    n = samples.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col("camera") < CAMERA_SWING).cast("double")).alias("steady"))
    run = n.join(steady_run(samples, key), key, "left").withColumn("r0", F.coalesce("r0", F.lit(0))).withColumn("r1", F.coalesce("r1", F.lit(0)))
    if durations is not None:
        run = run.join(durations.select(key, "dur", "vitality"), key, "left")
    else:
        run = run.withColumn("dur", F.lit(None).cast("double")).withColumn("vitality", F.lit(None).cast("double"))
    inside = samples.join(run.select(key, "r0", "r1"), key).filter((F.col("r1") == 0) | ((F.col("i") >= F.col("r0")) & (F.col("i") < F.col("r1"))))
    med = inside.groupBy(key).agg(F.median("camera").alias("cam"), F.percentile("subject", F.lit(0.75)).alias("subj"))
    r = run.join(med, key)
    s0 = F.col("r0") / float(FPS) + F.when(F.col("r0") > 0, 0.1).otherwise(0.0)
    s1 = F.col("r1") / float(FPS) - F.when(F.col("r1") < F.col("n"), 0.1).otherwise(0.0)
    s1 = F.when(F.coalesce("dur", F.lit(0.0)) != 0, F.least(s1, F.col("dur"))).otherwise(s1)
    r = r.withColumn("start_s", py_round(F.greatest(F.lit(0.0), s0), 2)).withColumn("end_s", py_round(F.greatest(F.lit(0.0), s1), 2))
    motion = (F.when(F.col("steady") < 0.35, "shaky").when(F.col("end_s") - F.col("start_s") < MIN_USABLE_S, "short")
              .when((F.col("vitality") < 0.2) & (F.col("subj") < SUBJECT_MIN * 2), "static")
              .when((F.col("subj") >= SUBJECT_MIN) & (F.col("cam") < CAMERA_SWING), "subject")
              .when((F.col("cam") >= CAMERA_STEADY * 0.3) & (F.col("cam") < CAMERA_SWING), "camera").otherwise("static"))
    return (r.withColumn("motion", motion).withColumn("usable", F.col("motion").isin("subject", "camera"))
            .select(key, "start_s", "end_s", F.col("cam").alias("camera"), F.col("subj").alias("subject"), "motion", "usable"))
