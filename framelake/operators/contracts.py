"""Contract checks. Each returns (entity, check, at); a clean entity has no row. Documents are bounded, so
their rules run inside the row as array expressions, with no shuffle."""
from pyspark.sql import Window, functions as F

# Vocabularies and limits of the contracts.
TAGS = ("landscape", "city", "architecture", "interior", "food", "drink", "people", "friends", "animals", "water", "night", "sunset", "transport", "market", "nature", "detail", "motion",
        "empty", "sky", "crowd", "religious", "art", "sport", "weather")
OBSTRUCTIONS = ("glass", "frame", "foreground_people", "foreground_object", "dirt", "reflection")
EMOTIONS = ("joy", "laughter", "surprise", "awe", "tender", "tension", "fear", "pride", "none")
FAMILIES = ("beat_photo_dump", "cinematic_pov", "narrated_documentary", "list", "expectation_vs_reality", "chain_or_route", "natural_sound", "character")
ROLES = ("hook", "development", "turn", "close")
QUOTA_CEILING = {"first_person": 0.8, "recap": 0.5, "place_first": 0.25}
ID, PATH = "^[a-z0-9][a-z0-9_-]*$", r"^(?!/Users/|/home/|/root/|[A-Za-z]:\\Users\\)"
LANG = "^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"
DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:?\d{2})?)?$"
MAX_BEAT_GAP, MIN_READ, MIN_CLOSE = 5.0, 0.8, 1.2
FRAMINGS, LIVE_MOTIONS = ("vertical", "horizontal", "square"), ("subject", "camera", "static", "shaky", "short", "unreadable")
ITEM_KEYS = ("id", "path", "type", "date", "place", "start_s", "end_s", "duration_s", "fps", "description", "quality", "obstructions", "hook", "subject_present", "favorite", "audio", "framing",
             "focus", "direction", "sheet", "tags", "notes", "use", "reason", "live", "human")
PLATFORMS, CUTS = ("tiktok", "reels", "shorts"), ("beat", "natural_sound", "narration", "free")
CLOSE_KINDS = ("punchline", "back_to_hook", "final_fact", "question", "loop")
QUOTA_KINDS = ("first_person", "recap", "place_first", "custom")
SEVERITIES, STATUSES, VERDICTS, PASSES, LEVELS = ("blocks", "important", "minor"), ("fixed", "open", "not_fixable"), ("ship", "rework", "reject"), ("pre", "post"), ("blocks", "optional")
LETTER, CONCEPT_ID = "^[A-H]$", "^[a-z0-9][a-z0-9-]*$"


def _empty():
    return F.from_json(F.lit("[]"), "array<struct<check:string,at:int>>")


def one(name, cond):
    return F.when(F.coalesce(cond, F.lit(False)), F.array(F.struct(F.lit(name).alias("check"), F.lit(None).cast("int").alias("at")))).otherwise(_empty())


def each(name, arr, cond):
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(arr), F.lit(1)) - 1), lambda i: F.coalesce(F.get(arr, i).isNotNull() & cond(F.get(arr, i)), F.lit(False))),
                       lambda i: F.struct(F.lit(name).alias("check"), i.alias("at")))


def pairs(name, arr, cond):
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(arr), F.lit(1)) - 1), lambda i: F.coalesce(F.get(arr, i + 1).isNotNull() & cond(F.get(arr, i), F.get(arr, i + 1)), F.lit(False))),
                       lambda i: F.struct(F.lit(name).alias("check"), (i + 1).alias("at")))


def words(**allowed):
    """One check per column: a value that is not in its vocabulary (<column>_vocabulary)."""
    return [one(f"{k}_vocabulary", ~F.col(k).isin(*v)) for k, v in allowed.items()]


def shorter(**least):
    """One check per column: a text of fewer letters (<column>_short)."""
    return [one(f"{k}_short", F.length(k) < n) for k, n in least.items()]


def outside(**bounds):
    """One check per column: a number out of its bounds, None for open ones (<column>_bounds)."""
    def bad(k, lo, hi):
        c = F.lit(False) if lo is None else F.col(k) < lo
        return c if hi is None else c | (F.col(k) > hi)
    return [one(f"{k}_bounds", bad(k, *b)) for k, b in bounds.items()]


def unlike(**patterns):
    return [one(f"{k}_pattern", ~F.col(k).rlike(p)) for k, p in patterns.items()]


def violations(df, key, *checks):
    return df.select(*key, F.explode(F.concat(*checks)).alias("_v")).select(*key, "_v.check", "_v.at")


# ---- moments ---------------------------------------------------------------------------------
def check_moments(m, key=("project_id", "id")):
    """Types, ranges, vocabularies, unknown keys and conditional requirements; windows and duplicates are separate. Columns
    of nested fields are flat (focus_x, pitch, live_motion); keys are those that the document has."""
    used = F.coalesce("use", F.lit(True))
    need = lambda c: used & F.col(c).isNull()
    rng = lambda c, lo, hi: F.col(c).isNotNull() & ~F.col(c).between(lo, hi)
    has_o = F.coalesce(F.size("obstructions"), F.lit(0)) > 0
    return violations(m, key,
        one("id_pattern", ~F.col("id").rlike(ID)), one("path_private", ~F.col("path").rlike(PATH)), one("path_missing", F.col("path").isNull() | (F.col("path") == "")), one("type_vocabulary", ~F.col("type").isin("photo", "video", "video360", "live")),
        one("date_format", ~F.col("date").rlike(DATE)), one("quality_range", rng("quality", 1, 5)), one("hook_range", rng("hook", 1, 5)), one("start_negative", F.col("start_s") < 0),
        one("story_range", rng("story_potential", 0, 5)), one("emotion_vocabulary", ~F.col("emotion").isin(*EMOTIONS)), one("video_window", F.col("type").isin("video", "video360") & (F.col("start_s").isNull() | F.col("end_s").isNull())),
        one("dropped_reason", ~used & (F.col("reason").isNull() | (F.length("reason") < 3))), one("needs_description", need("description")), one("needs_quality", need("quality")), one("needs_hook", need("hook")),
        one("needs_subject", need("subject_present")), one("needs_sheet", need("sheet")), one("needs_tags", need("tags")), one("tags_empty", F.size("tags") == 0), one("tags_repeat", F.size("tags") != F.size(F.array_distinct("tags"))),
        each("tag_vocabulary", F.col("tags"), lambda t: ~t.isin(*TAGS)), each("obstruction_vocabulary", F.col("obstructions"), lambda t: ~t.isin(*OBSTRUCTIONS)),
        one("sphere_direction", (F.col("type") == "video360") & used & F.col("yaw").isNull()), one("yaw_range", rng("yaw", -360, 360)), *outside(pitch=(-90, 90), fov=(10, 180), focus_x=(0, 1), focus_y=(0, 1), fps=(1, None), end_s=(0, None), duration_s=(0, None)),
        *shorter(description=12), *words(framing=FRAMINGS, live_motion=LIVE_MOTIONS), one("obstructions_repeat", F.size("obstructions") != F.size(F.array_distinct("obstructions"))),
        each("unknown_key", F.col("keys"), lambda k: ~k.isin(*ITEM_KEYS)), one("obstruction_notes", has_o & F.col("notes").isNull()), one("obstruction_quality", has_o & (F.col("quality") > 2)))


# ---- concepts: one row with blocks, beats, variants and resources as arrays --------------------
def _end():
    last = F.get("blocks", F.size("blocks") - 1)
    return F.coalesce(last["t1"], F.col("target_duration_s"), F.lit(0.0))


def beat_gaps(c, key=("concept_id",)):
    raises = F.filter(F.transform("beats", lambda b: F.lower(F.trim(b["raises"]))), lambda x: x.isNotNull() & (x != ""))
    return violations(c, key, pairs("beat_order", F.col("beats"), lambda a, b: b["at_s"] <= a["at_s"]),
                      pairs("beat_gap", F.col("beats"), lambda a, b: (b["at_s"] > a["at_s"]) & (b["at_s"] - a["at_s"] > MAX_BEAT_GAP) & (F.trim(F.coalesce(a["mini_hook"], F.lit(""))) == "")),
                      one("beats_repeat", F.size(raises) != F.size(F.array_distinct(raises))))


def structure_checks(c, key=("concept_id",)):
    b = F.col("blocks")
    roles = F.filter(b, lambda x: x["role"].isNotNull())
    rank = F.filter(F.transform(roles, lambda x: F.array_position(F.array(*[F.lit(r) for r in ROLES]), x["role"])), lambda x: x > 0)
    close = F.aggregate(F.filter(b, lambda x: x["role"] == "close"), F.lit(0.0), lambda s, x: s + (x["t1"] - x["t0"]))
    some = F.size(roles) > 0
    return violations(c, key, pairs("overlap", b, lambda x, y: y["t0"] < x["t1"]), each("inverted", b, lambda x: x["t1"] <= x["t0"]),
                      each("unreadable_text", b, lambda x: x["text"].isNotNull() & (x["text"] != "") & (x["t1"] - x["t0"] < MIN_READ)), one("role_missing", some & (F.size(roles) != F.size(b))),
                      one("role_order", some & (rank != F.array_sort(rank))), one("last_not_close", some & (F.get(roles, F.size(roles) - 1)["role"] != "close")), one("close_short", some & (close != 0) & (close < MIN_CLOSE)))


def check_arc(c, key=("concept_id",)):
    end = _end()
    hooks = F.filter("blocks", lambda x: x["role"] == "hook")
    played = F.array_max(F.transform(hooks, lambda x: x["t1"]))
    says = F.exists("blocks", lambda x: x["says"].isNotNull() & (x["says"] != ""))
    return violations(c, key, one("promise_after_end", (end > 0) & (F.col("paid_off_s") > end + 0.5)), one("promise_too_early", (end > 0) & (F.col("paid_off_s") <= end + 0.5) & (F.col("paid_off_s") < end / 3)),
                      one("hook_clock", F.abs(played - F.col("hook_ends_s")) > 0.5), one("turn_after_end", (end > 0) & (F.col("turn_s") > end + 0.5)), one("close_after_end", (end > 0) & (F.col("close_s") > end + 0.5)),
                      one("narration_without_says", F.col("narration") & (F.size("blocks") > 0) & ~F.coalesce(says, F.lit(False))))


def undeclared(c, key=("concept_id",)):
    used = F.array_distinct(F.filter(F.transform("blocks", lambda b: b["resource"]), lambda x: x.isNotNull()))
    return (c.filter(F.size("resources") > 0).select(*key, F.explode(F.array_except(used, F.col("resources"))).alias("resource")))


def new_material(c, key=("concept_id",), share=0.4):
    need = F.ceil(F.size("resources") * F.lit(share)).cast("int")
    v = c.select(*key, F.when(F.size("resources") > 0, need).otherwise(0).alias("need"), F.explode("variants").alias("v"))
    return v.filter((F.col("v.differs_in") != "base") & (F.coalesce("v.n_new", F.lit(0)) < F.col("need"))).select(*key, "v.letter", F.col("v.i").alias("i"), F.coalesce("v.n_new", F.lit(0)).alias("got"), "need")


def check_variants(c, key=("concept_id",)):
    v = F.col("variants")
    is_ = lambda x, a: x["differs_in"] == a
    voiced = F.array_distinct(F.transform(v, lambda x: F.coalesce(x["narrated"], F.col("narration"), F.lit(False))))
    letters = F.transform(v, lambda x: x["letter"])
    text = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(None).cast("string"))
    sig = F.transform(v, lambda x: F.concat_ws("|", x["differs_in"], F.coalesce(text(x["hook_resource"]), text(x["close_resource"]), x["narrated"].cast("string"), F.lit("-"))))
    idx = F.sequence(F.lit(0), F.greatest(F.size(v), F.lit(1)) - 1)
    repeat = F.transform(F.filter(idx, lambda i: F.coalesce(F.get(v, i)["differs_in"].isin("hook", "close", "voice") & (F.array_position(sig, F.get(sig, i)) < i + 1), F.lit(False))), lambda i: F.struct(F.lit("same_change").alias("check"), i.alias("at")))
    # Ways to say that only the song changes.
    song = F.lit("other song|another song|different song|otra canción|same cuts")
    return violations(c, key, one("many_bases", F.size(F.filter(v, lambda x: is_(x, "base"))) > 1),
                      each("hook_unnamed", v, lambda x: is_(x, "hook") & (F.coalesce(x["hook_resource"], F.lit("")) == "")), each("hook_same", v, lambda x: is_(x, "hook") & (x["hook_resource"] == F.col("hook_resource"))),
                      each("close_unnamed", v, lambda x: is_(x, "close") & (F.coalesce(x["close_resource"], F.lit("")) == "")), each("close_same", v, lambda x: is_(x, "close") & (x["close_resource"] == F.col("close_resource"))),
                      one("voice_not_different", F.exists(v, lambda x: is_(x, "voice")) & (F.size(voiced) < 2)),
                      each("song_only", v, lambda x: F.rlike(F.lower(x["what"]), song) & ~x["differs_in"].isin("hook", "close", "voice", "shots")),
                      one("letter_repeat", F.size(letters) != F.size(F.array_distinct(letters))), repeat)


def check_concepts(c, key=("concept_id",)):
    """Fields and conditional requirements of a concept, its length and its subject quota."""
    ceiling = F.coalesce(*[F.when(F.col("quota_kind") == k, v) for k, v in QUOTA_CEILING.items()], F.lit(1.0))
    total = F.get("blocks", F.size("blocks") - 1)["t1"]
    ratio = F.size(F.filter("blocks", lambda x: x["subject"])) / F.size("blocks")
    t = F.col("target_duration_s")
    return violations(c, key, one("family_vocabulary", ~F.col("family").isin(*FAMILIES)), one("lang_format", ~F.col("lang").rlike(LANG)), one("duration_range", ~t.between(6, 180)), one("rationale_short", F.length("duration_rationale") < 20),
                      one("beat_needs_bpm", (F.col("cut_to") == "beat") & F.col("bpm").isNull()), one("bpm_range", ~F.col("bpm").between(40, 220)), one("long_needs_turn", (t > 35) & F.col("turn_s").isNull()), one("hook_ends_range", ~F.col("hook_ends_s").between(0.5, 3)),
                      one("quota_ceiling", F.col("max_ratio") > ceiling), one("quota_custom_note", (F.col("quota_kind") == "custom") & F.col("quota_note").isNull()), one("beats_few", F.coalesce(F.size("beats"), F.lit(0)) < 2), one("structure_short", F.size("blocks") < 2),
                      one("variants_count", ~F.coalesce(F.size("variants"), F.lit(0)).between(2, 5)), one("length_mismatch", (t != 0) & (F.abs(total - t) > F.greatest(F.lit(3.0), t * 0.25))),
                      one("subject_over_quota", (F.size("blocks") > 0) & (ratio > F.col("max_ratio") + 1e-9)),
                      *words(platform=PLATFORMS, cut_to=CUTS, close_kind=CLOSE_KINDS, quota_kind=QUOTA_KINDS), *outside(max_ratio=(0, 1), min_ratio=(0, 1), beat0_s=(0, None), paid_off_s=(1, None), anchor_at_s=(0, None)),
                      *shorter(title=3, hook_visual=8, promise=12, lands_because=12, anchor_what=8), one("promise_missing", F.col("promise").isNull()), one("close_missing", F.col("close_kind").isNull()),
                      each("letter_pattern", F.col("variants"), lambda v: ~v["letter"].rlike(LETTER)), one("resources_repeat", F.size("resources") != F.size(F.array_distinct("resources"))))


def story_anchor(concepts, stories, g="project_id", key="concept_id"):
    """Concepts that use none of their project's stories, and unknown story ids."""
    told = stories.select(g).distinct()
    none = concepts.filter(F.size(F.coalesce("stories", F.array().cast("array<string>"))) == 0).join(told, g, "left_semi").select(key, F.lit("no_story").alias("check"), F.lit(None).cast("string").alias("story"))
    used = concepts.select(key, g, F.explode("stories").alias("story")).distinct()
    unknown = used.join(told, g, "left_semi").join(stories.select(g, F.col("id").alias("story")), [g, "story"], "left_anti")
    return none.unionByName(unknown.select(key, F.lit("unknown_story").alias("check"), "story"))


def check_human(concepts, stories, key="concept_id"):
    missing = concepts.filter(~F.coalesce("human_anchor", F.lit(False))).select(key, F.lit("no_human_anchor").alias("check"), F.lit(None).cast("string").alias("story"))
    return missing.unionByName(story_anchor(concepts, stories, key=key))


# ---- scripts, builds, reviews, stories -----------------------------------------------------------
def check_voice_script(s, key=("script_id",)):
    """s(script_id, lang, video_duration_s, lines[])."""
    ln = F.col("lines")
    order = lambda a, b: b["start_s"] <= a["start_s"]
    two = lambda a, b: (a["duration_hint_s"] != 0) & (a["start_s"] + a["duration_hint_s"] > b["start_s"] + 1e-9)
    return violations(s, key, one("lang_format", ~F.col("lang").rlike(LANG)), one("no_lines", F.coalesce(F.size("lines"), F.lit(0)) == 0), each("text_short", ln, lambda x: x["text"].isNull() | (F.length(x["text"]) < 2)),
                      each("start_missing", ln, lambda x: x["start_s"].isNull()), each("start_negative", ln, lambda x: x["start_s"] < 0), each("hint_short", ln, lambda x: x["duration_hint_s"] < 0.2),
                      pairs("out_of_order", ln, order), pairs("two_voices", ln, two), each("past_the_end", ln, lambda x: (F.col("video_duration_s") > 0) & (x["start_s"] >= F.col("video_duration_s"))),
                      one("never_ducks", (F.size("lines") > 0) & F.forall(ln, lambda x: F.coalesce(~x["duck"], F.lit(False)))))


def check_builds(b, key=("variant_id",)):
    return violations(b, key, one("subject_over_cuts", F.col("cuts_with_subject") > F.col("cuts")), one("peak", F.col("peak_dbtp") > -0.5), one("black_frames", F.col("black_frames") > 0),
                      one("audio_video_gap", F.abs(F.col("audio_duration_s") - F.col("video_duration_s")) > 0.5), one("audio_tracks", F.col("audio_tracks") != 1), one("out_of_window", F.col("out_of_window").isNotNull()),
                      one("narrated_without_script", F.col("narrated") & F.col("voice_script").isNull()))


def check_reviews(r, key=("variant_id",)):
    """One row per reviewed variant with its counts, verdict and problem."""
    ratio = F.col("subject_cuts") / F.col("cuts")
    ok = (ratio <= F.coalesce("max_ratio", F.lit(1.0)) + 1e-9) & (F.col("min_ratio").isNull() | (ratio >= F.col("min_ratio") - 1e-9))
    return violations(r, key, one("ratio", (F.col("cuts") > 0) & (F.abs(ratio - F.col("ratio")) > 0.01)), one("pass", (F.col("cuts") > 0) & (F.col("pass") != ok)),
                      one("approved_with_blocker", F.col("approved") & (F.col("severity") == "blocks") & (F.col("status") == "open")), one("not_fixable_reason", (F.col("status") == "not_fixable") & F.col("reason").isNull()),
                      one("language", ~F.coalesce("language_ok", F.lit(True))), *words(severity=SEVERITIES, status=STATUSES), *unlike(letter=LETTER, recommended=LETTER, readme=PATH),
                      *shorter(what=8, place=1, how_to_fix=8, comparison=20), *outside(cuts=(1, None), subject_cuts=(0, None), ratio=(0, 1)))


def check_stories(s, key=("concept_id",)):
    ship = F.col("verdict") == "ship"
    rec, dec = F.col("recommended_s"), F.col("declared_s")
    return violations(s, key, one("paid_without_second", F.col("paid_ok") & F.col("paid_at").isNull()), one("ship_unpaid", ship & ~F.col("paid_ok")), one("ship_no_close", ship & ~F.col("close_ok")), one("ship_with_blockers", ship & (F.col("n_blocks") > 0)),
                      one("duration_without_seconds", (rec != 0) & (dec != 0) & (F.abs(rec - dec) > F.greatest(F.lit(2.0), dec * 0.15)) & (F.col("n_windows") == 0)),
                      one("variant_too_long", (rec != 0) & (F.col("variant_s") > rec * 2)), one("post_without_variants", (F.col("pass") == "post") & (F.col("n_watched") == 0)),
                      *words(verdict=VERDICTS, close_kind=CLOSE_KINDS, fix_level=LEVELS, **{"pass": PASSES}), *unlike(concept=CONCEPT_ID, fix_variant=LETTER), *shorter(in_beats=12, fix_what=12, fix_why=8),
                      *outside(recommended_s=(3, None), declared_s=(0, None), beats=(0, None), largest_gap_s=(0, None)))


# ---- round level -------------------------------------------------------------------------------
def quota(cuts, limits, key=("variant_id",)):
    """Share of cuts with the subject per variant against ceiling and floor."""
    q = cuts.groupBy(*key).agg(F.count("*").alias("cuts"), F.count_if("subject").alias("subject_cuts")).join(limits, list(key))
    ratio = F.col("subject_cuts") / F.col("cuts")
    return q.withColumn("ratio", ratio).withColumn("pass", (F.col("ratio") <= F.coalesce("max_ratio", F.lit(1.0)) + 1e-9) & (F.col("min_ratio").isNull() | (F.col("ratio") >= F.col("min_ratio") - 1e-9)))


def variety(concepts, durations, g="project_id"):
    """Repeated families and how far apart the lengths of a round are."""
    f = concepts.groupBy(g, "family").agg(F.count("*").alias("_n")).groupBy(g).agg(F.sum("_n").alias("concepts"), F.count("*").alias("families"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("in_repeated_family"))
    d = durations.groupBy(g).agg(F.min("duration_s").alias("shortest"), F.max("duration_s").alias("longest"))
    return f.join(d, g, "left").withColumn("within_5s", F.col("longest") - F.col("shortest") < 5).withColumn("within_10s", F.col("longest") - F.col("shortest") < 10)


def shared_resources(blocks, heads, g="project_id"):
    """Resources used by several concepts of one project."""
    b = blocks.filter("resource is not null").join(heads.select("concept_id", g), "concept_id").select(g, "resource", "concept_id").distinct()
    return b.groupBy(g, "resource").agg(F.count("*").alias("concepts"), F.min("concept_id").alias("first_concept"), F.max("concept_id").alias("last_concept")).filter("concepts > 1")


def deliverable(v="deliverable"):
    return F.coalesce(F.col(v), F.lit(True))


def delivery(variants, g="concept_id"):
    ok = F.col("verify_pass") & deliverable()
    return variants.groupBy(g).agg(F.count_if(ok).alias("delivered"), F.count_if(~ok).alias("blocked"), F.count_if(F.coalesce("skipped", F.lit("")) != "").alias("with_skips"),
                                   F.min("duration_s").alias("shortest"), F.max("duration_s").alias("longest"))


def blockers(problems, fixes, variants, min_score=65):
    """What stops a variant, from four origins: story pass, reviewer, gate, rubric."""
    cols = ["concept_id", "letter", "origin", "what"]
    arc = fixes.filter("level = 'blocks'").select("concept_id", "letter", F.lit("story").alias("origin"), "what")
    rev = problems.filter("severity = 'blocks'").select("concept_id", "letter", F.lit("review").alias("origin"), F.lit("review problem").alias("what"))
    gate = variants.filter(~F.col("verify_pass") & deliverable()).select("concept_id", "letter", F.lit("gate").alias("origin"), F.lit("it does not pass the delivery gate").alias("what"))
    has = arc.select("concept_id", "letter").distinct()
    low = (variants.filter(F.col("rubric_total") < min_score).join(has, ["concept_id", "letter"], "left_anti")
           .select("concept_id", "letter", F.lit("rubric").alias("origin"), F.concat(F.lit("it scores "), F.col("rubric_total").cast("string")).alias("what")))
    return arc.unionByName(rev).unionByName(gate).unionByName(low).select(*cols)


def merge_fixed(base, repair, key=("concept_id", "letter"), cols=("verify_pass", "rubric_total")):
    """The latest repair wins by letter; the rest is kept, new letters are added."""
    b = base.select(*key, F.struct(*cols).alias("_b"))
    r = repair.select(*key, F.struct(*cols).alias("_r"))
    return b.join(r, list(key), "full").select(*key, F.coalesce("_r", "_b").alias("_x"), F.col("_r").isNotNull().alias("repaired")).select(*key, "_x.*", "repaired")
