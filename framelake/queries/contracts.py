"""Contract and round-level queries."""
from pyspark.sql import functions as F

from framelake.operators import contracts as C
from framelake.registry import query


def arr(df, key, *cols):
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", *cols))).alias("_a"))


def concepts(t, *parts):
    """Concept documents: one row with its blocks, beats, variants and declared resources, or some of them."""
    k = "concept_id"
    make = {
        "blocks": lambda: arr(t.c_blocks, k, "t0", "t1", "resource", "role", "text", "subject", "says").withColumnRenamed("_a", "blocks"),
        "beats": lambda: arr(t.c_beats, k, "at_s", "raises", "mini_hook").withColumnRenamed("_a", "beats"),
        "variants": lambda: arr(t.c_variants, k, "letter", "differs_in", "hook_resource", "close_resource", "narrated", "what", "n_new").withColumnRenamed("_a", "variants"),
        "resources": lambda: t.c_blocks.groupBy(k).agg(F.collect_set(F.expr("if(l_partkey % 7 = 0, concat(resource, '-old'), resource)")).alias("resources")),
    }
    out = t.c_head
    for p in parts or make:
        out = out.join(make[p](), k, "left")
    return out


CON = ["c_head", "c_blocks", "c_beats", "c_variants"]


def rules(frm, key, *items):
    """UNION of (check, condition, position) over one table."""
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS \"check\", CAST({at} AS INT) AS at FROM {frm} WHERE {c}" for n, c, at in items)


def sql_words(**allowed):
    return [(f"{k}_vocabulary", f"{k} NOT IN ({', '.join(repr(x) for x in v)})", "NULL") for k, v in allowed.items()]


def sql_shorter(**least):
    return [(f"{k}_short", f"length({k}) < {n}", "NULL") for k, n in least.items()]


def sql_outside(**bounds):
    return [(f"{k}_bounds", " OR ".join([f"{k} < {lo}"] * (lo is not None) + [f"{k} > {hi}"] * (hi is not None)), "NULL") for k, (lo, hi) in bounds.items()]


def sql_unlike(**patterns):
    return [(f"{k}_pattern", f"NOT regexp_matches({k}, '{p}')", "NULL") for k, p in patterns.items()]


_BT = "(SELECT *, lag(at_s) OVER w AS pa, lag(mini_hook) OVER w AS pm, row_number() OVER w - 1 AS n FROM c_beats WINDOW w AS (PARTITION BY concept_id ORDER BY i)) z"


@query("WN-06", CON, rules(_BT, "concept_id", ("beat_order", "at_s <= pa", "n"), ("beat_gap", "at_s > pa AND at_s - pa > 5 AND coalesce(pm, '') = ''", "n"))
       + " UNION ALL SELECT concept_id, 'beats_repeat', NULL FROM c_beats GROUP BY 1 HAVING count(*) <> count(DISTINCT lower(raises))")
def _(t):
    return C.beat_gaps(concepts(t, "beats"))


_BL = "(SELECT *, lag(t1) OVER (PARTITION BY concept_id ORDER BY i) AS p1 FROM c_blocks) z"
_RK = "CASE role WHEN 'hook' THEN 1 WHEN 'development' THEN 2 WHEN 'turn' THEN 3 WHEN 'close' THEN 4 END"


@query("WN-07", CON, rules(_BL, "concept_id", ("overlap", "t0 < p1", "i"), ("inverted", "t1 <= t0", "i"), ("unreadable_text", "text <> '' AND t1 - t0 < 0.8", "i"))
       + f""" UNION ALL SELECT concept_id, c, NULL FROM (SELECT concept_id, count(role) AS nr, count(*) AS n, arg_max(role, i) FILTER (role IS NOT NULL) AS last, sum(t1 - t0 ORDER BY i) FILTER (role = 'close') AS cl FROM c_blocks GROUP BY 1) g
       LEFT JOIN (SELECT DISTINCT concept_id AS bad FROM (SELECT concept_id, {_RK} AS k, max({_RK}) OVER (PARTITION BY concept_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c_blocks WHERE role IS NOT NULL) o WHERE k < m) b ON b.bad = g.concept_id,
       (VALUES ('role_missing'), ('role_order'), ('last_not_close'), ('close_short')) x(c) WHERE (c = 'role_missing' AND nr > 0 AND nr <> n) OR (c = 'role_order' AND bad IS NOT NULL) OR (c = 'last_not_close' AND nr > 0 AND last <> 'close') OR (c = 'close_short' AND cl <> 0 AND cl < 1.2)""")
def _(t):
    return C.structure_checks(concepts(t, "blocks"))


_ARC = """(SELECT h.*, coalesce(b.e, target_duration_s) AS e, b.played, b.says FROM c_head h LEFT JOIN (SELECT concept_id, arg_max(t1, i) AS e, max(t1) FILTER (role = 'hook') AS played, count(says) AS says FROM c_blocks GROUP BY 1) b ON b.concept_id = h.concept_id) z"""


@query("DQ-03", CON, rules(_ARC, "concept_id", ("promise_after_end", "e > 0 AND paid_off_s > e + 0.5", "NULL"), ("promise_too_early", "e > 0 AND paid_off_s <= e + 0.5 AND paid_off_s < e / 3", "NULL"), ("hook_clock", "abs(played - hook_ends_s) > 0.5", "NULL"),
       ("turn_after_end", "e > 0 AND turn_s > e + 0.5", "NULL"), ("close_after_end", "e > 0 AND close_s > e + 0.5", "NULL"), ("narration_without_says", "narration AND says = 0", "NULL")))
def _(t):
    return C.check_arc(concepts(t, "blocks"))


_CON = """(SELECT h.*, b.total, b.n, b.subj, coalesce(e.n, 0) AS beats, coalesce(v.n, 0) AS vars FROM c_head h JOIN (SELECT concept_id, arg_max(t1, i) AS total, count(*) AS n, count(*) FILTER (subject) AS subj FROM c_blocks GROUP BY 1) b USING (concept_id)
   LEFT JOIN (SELECT concept_id, count(*) AS n FROM c_beats GROUP BY 1) e USING (concept_id) LEFT JOIN (SELECT concept_id, count(*) AS n FROM c_variants GROUP BY 1) v USING (concept_id)) z"""


@query("DQ-02", CON, rules(_CON, "concept_id", ("family_vocabulary", "family = 'vlog'", "NULL"), ("lang_format", "lang = 'english'", "NULL"), ("duration_range", "target_duration_s < 6 OR target_duration_s > 180", "NULL"), ("rationale_short", "length(duration_rationale) < 20", "NULL"),
       ("beat_needs_bpm", "cut_to = 'beat' AND bpm IS NULL", "NULL"), ("bpm_range", "bpm < 40 OR bpm > 220", "NULL"), ("long_needs_turn", "target_duration_s > 35 AND turn_s IS NULL", "NULL"), ("hook_ends_range", "hook_ends_s < 0.5 OR hook_ends_s > 3", "NULL"),
       ("quota_ceiling", "max_ratio > CASE quota_kind WHEN 'first_person' THEN 0.8::DOUBLE WHEN 'recap' THEN 0.5::DOUBLE WHEN 'place_first' THEN 0.25::DOUBLE ELSE 1 END", "NULL"), ("quota_custom_note", "quota_kind = 'custom' AND quota_note IS NULL", "NULL"), ("beats_few", "beats < 2", "NULL"),
       ("structure_short", "n < 2", "NULL"), ("variants_count", "vars < 2 OR vars > 5", "NULL"), ("length_mismatch", "target_duration_s <> 0 AND abs(total - target_duration_s) > greatest(3, target_duration_s * 0.25::DOUBLE)", "NULL"), ("subject_over_quota", "subj / n > max_ratio + 1e-9", "NULL"),
       *sql_words(platform=("tiktok", "reels", "shorts"), cut_to=("beat", "natural_sound", "narration", "free"), close_kind=("punchline", "back_to_hook", "final_fact", "question", "loop"), quota_kind=("first_person", "recap", "place_first", "custom")),
       *sql_outside(max_ratio=(0, 1), min_ratio=(0, 1), beat0_s=(0, None), paid_off_s=(1, None), anchor_at_s=(0, None)), *sql_shorter(title=3, hook_visual=8, promise=12, lands_because=12, anchor_what=8),
       ("promise_missing", "promise IS NULL", "NULL"), ("close_missing", "close_kind IS NULL", "NULL")) + """ UNION ALL
   SELECT concept_id, 'letter_pattern', CAST(n AS INT) FROM (SELECT concept_id, letter, row_number() OVER (PARTITION BY concept_id ORDER BY i) - 1 AS n FROM c_variants) v WHERE NOT regexp_matches(letter, '^[A-H]$') UNION ALL
   SELECT concept_id, 'resources_repeat', NULL FROM c_blocks GROUP BY concept_id HAVING count(resource) <> count(DISTINCT resource)""")
def _(t):
    listed = t.c_blocks.groupBy("concept_id").agg(F.collect_list("resource").alias("resources"))
    return C.check_concepts(concepts(t, "blocks", "beats", "variants").join(listed, "concept_id", "left"))


_VA = "(SELECT v.*, h.hook_resource AS hr, h.close_resource AS cr, row_number() OVER (PARTITION BY v.concept_id ORDER BY v.i) - 1 AS n, differs_in || '|' || coalesce(nullif(v.hook_resource, ''), nullif(v.close_resource, ''), CASE narrated WHEN TRUE THEN 'true' WHEN FALSE THEN 'false' END, '-') AS sig FROM c_variants v JOIN c_head h USING (concept_id)) z"


@query("DQ-04", CON, rules(_VA, "concept_id", ("hook_unnamed", "differs_in = 'hook' AND hook_resource IS NULL", "n"), ("hook_same", "differs_in = 'hook' AND hook_resource = hr", "n"), ("close_unnamed", "differs_in = 'close' AND close_resource IS NULL", "n"), ("close_same", "differs_in = 'close' AND close_resource = cr", "n"),
       ("song_only", "regexp_matches(lower(what), 'other song|same cuts') AND differs_in NOT IN ('hook', 'close', 'voice', 'shots')", "n"))
       + f" UNION ALL SELECT concept_id, 'same_change', CAST(n AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, sig ORDER BY i) AS r FROM {_VA}) q WHERE r > 1 AND differs_in IN ('hook', 'close', 'voice')"
       + " UNION ALL SELECT concept_id, 'many_bases', NULL FROM c_variants GROUP BY 1 HAVING count(*) FILTER (differs_in = 'base') > 1 UNION ALL SELECT concept_id, 'letter_repeat', NULL FROM c_variants GROUP BY 1 HAVING count(*) <> count(DISTINCT letter)"
       + " UNION ALL SELECT concept_id, 'voice_not_different', NULL FROM c_variants GROUP BY 1 HAVING bool_or(differs_in = 'voice') AND count(DISTINCT coalesce(narrated, narration, FALSE)) < 2")
def _(t):
    return C.check_variants(concepts(t, "variants"))


_RES = "(SELECT DISTINCT concept_id, CASE WHEN l_partkey % 7 = 0 THEN resource || '-old' ELSE resource END AS resource FROM c_blocks)"


@query("SO-06", CON, f"SELECT DISTINCT b.concept_id, b.resource FROM c_blocks b WHERE b.concept_id IN (SELECT concept_id FROM {_RES} r) AND NOT EXISTS (SELECT 1 FROM {_RES} r WHERE r.concept_id = b.concept_id AND r.resource = b.resource)")
def _(t):
    return C.undeclared(concepts(t, "blocks", "resources"))


@query("SO-07", CON, f"SELECT v.concept_id, v.letter, v.i, v.n_new AS got, CAST(coalesce(need, 0) AS INT) AS need FROM c_variants v LEFT JOIN (SELECT concept_id, ceil(count(*) * 0.4::DOUBLE) AS need FROM {_RES} r GROUP BY 1) n USING (concept_id) WHERE differs_in <> 'base' AND n_new < coalesce(need, 0)")
def _(t):
    return C.new_material(concepts(t, "variants", "resources"))


_ST = """SELECT concept_id, 'no_story' AS "check", NULL AS story FROM c_head h WHERE story IS NULL AND project_id IN (SELECT project_id FROM c_stories) UNION ALL SELECT concept_id, 'unknown_story', story FROM c_head h WHERE story IS NOT NULL AND project_id IN (SELECT project_id FROM c_stories)
   AND NOT EXISTS (SELECT 1 FROM c_stories s WHERE s.project_id = h.project_id AND s.id = h.story)"""


def with_stories(t):
    return t.c_head.withColumn("stories", F.array_compact(F.array("story")))


@query("JN-35", ["c_head", "c_stories"], _ST)
def _(t):
    return C.story_anchor(with_stories(t), t.c_stories)


@query("DQ-05", ["c_head", "c_stories"], _ST + " UNION ALL SELECT concept_id, 'no_human_anchor', NULL FROM c_head WHERE NOT human_anchor")
def _(t):
    return C.check_human(with_stories(t), t.c_stories)


_VS = "(SELECT t.*, h.lang, total_s * 0.9::DOUBLE AS d, lag(start_s) OVER w AS ps, lag(duration_s) OVER w AS ph, row_number() OVER w - 1 AS n FROM talk_lines t JOIN totals USING (video_id) JOIN c_head h ON h.concept_id = t.video_id WINDOW w AS (PARTITION BY t.video_id ORDER BY t.i)) z"


@query("DQ-06", ["talk_lines", "totals", "c_head"], rules(_VS, "video_id AS script_id", ("text_short", "length(text) < 2", "n"), ("start_missing", "start_s IS NULL", "n"), ("start_negative", "start_s < 0", "n"), ("hint_short", "duration_s < 0.2", "n"), ("out_of_order", "start_s <= ps", "n"),
       ("two_voices", "ph <> 0 AND ps + ph > start_s + 1e-9", "n"), ("past_the_end", "d > 0 AND start_s >= d", "n"))
       + f" UNION ALL SELECT DISTINCT video_id, 'lang_format', NULL FROM {_VS} WHERE lang = 'english' UNION ALL SELECT video_id, 'never_ducks', NULL FROM talk_lines GROUP BY 1 HAVING bool_and(i % 5 = 0)")
def _(t):
    lines = t.talk_lines.withColumn("duck", F.col("i") % 5 != 0).withColumnRenamed("duration_s", "duration_hint_s")
    s = arr(lines, "video_id", "start_s", "text", "duration_hint_s", "duck").withColumnRenamed("_a", "lines").join(t.totals, "video_id")
    s = s.join(t.c_head.select(F.col("concept_id").alias("video_id"), "lang"), "video_id").withColumn("video_duration_s", F.col("total_s") * 0.9).withColumnRenamed("video_id", "script_id")
    return C.check_voice_script(s)


@query("DQ-07", ["builds"], rules("builds", "variant_id", ("subject_over_cuts", "cuts_with_subject > cuts", "NULL"), ("peak", "peak_dbtp > -0.5", "NULL"), ("black_frames", "black_frames > 0", "NULL"), ("audio_video_gap", "abs(audio_duration_s - video_duration_s) > 0.5", "NULL"),
       ("audio_tracks", "audio_tracks <> 1", "NULL"), ("out_of_window", "out_of_window IS NOT NULL", "NULL"), ("narrated_without_script", "narrated AND voice_script IS NULL", "NULL")))
def _(t):
    return C.check_builds(t.builds)


_OKR = "(subject_cuts / cuts <= max_ratio + 1e-9 AND (min_ratio IS NULL OR subject_cuts / cuts >= min_ratio - 1e-9))"


@query("DQ-08", ["reviews"], rules("reviews", "variant_id", ("ratio", "abs(subject_cuts / cuts - ratio) > 0.01", "NULL"), ("pass", f"pass <> {_OKR}", "NULL"), ("approved_with_blocker", "approved AND severity = 'blocks' AND status = 'open'", "NULL"),
       ("not_fixable_reason", "status = 'not_fixable' AND reason IS NULL", "NULL"), ("language", "NOT language_ok", "NULL"), *sql_words(severity=("blocks", "important", "minor"), status=("fixed", "open", "not_fixable")),
       *sql_unlike(letter="^[A-H]$", recommended="^[A-H]$"), ("readme_pattern", "starts_with(readme, '/home/')", "NULL"), *sql_shorter(what=8, place=1, how_to_fix=8, comparison=20), *sql_outside(cuts=(1, None), subject_cuts=(0, None), ratio=(0, 1))))
def _(t):
    return C.check_reviews(t.reviews)


@query("DQ-09", ["story_reviews"], rules("story_reviews", "concept_id", ("paid_without_second", "paid_ok AND paid_at IS NULL", "NULL"), ("ship_unpaid", "verdict = 'ship' AND NOT paid_ok", "NULL"), ("ship_no_close", "verdict = 'ship' AND NOT close_ok", "NULL"), ("ship_with_blockers", "verdict = 'ship' AND n_blocks > 0", "NULL"),
       ("duration_without_seconds", "abs(recommended_s - declared_s) > greatest(2, declared_s * 0.15::DOUBLE) AND n_windows = 0", "NULL"), ("variant_too_long", "variant_s > recommended_s * 2", "NULL"), ("post_without_variants", "pass = 'post' AND n_watched = 0", "NULL"),
       *sql_words(verdict=("ship", "rework", "reject"), close_kind=("punchline", "back_to_hook", "final_fact", "question", "loop"), fix_level=("blocks", "optional"), **{"pass": ("pre", "post")}), *sql_unlike(concept="^[a-z0-9][a-z0-9-]*$", fix_variant="^[A-H]$"),
       *sql_shorter(in_beats=12, fix_what=12, fix_why=8), *sql_outside(recommended_s=(3, None), declared_s=(0, None), beats=(0, None), largest_gap_s=(0, None))))
def _(t):
    return C.check_stories(t.story_reviews)


# One document per moment with every kind of fault, in both dialects: the rules are stated on its fields alone.
_MO_FIELDS = """project_id, CASE WHEN quality = 5 THEN upper(id) || '!' ELSE id END AS id, CASE WHEN batch = 7 THEN '/home/u/' || path WHEN batch = 11 THEN '' ELSE path END AS path,
   CASE WHEN batch = 0 THEN 'movie' WHEN type = '360' THEN 'video360' ELSE type END AS type, CASE WHEN batch = 3 THEN 'soon' ELSE CAST(CAST(date AS DATE) AS VARCHAR(10)) END AS date, quality + CASE WHEN batch = 2 THEN 2 ELSE 0 END AS quality,
   hook - CASE WHEN batch = 2 THEN 1 ELSE 0 END AS hook, start_s - CASE WHEN batch = 1 THEN 10 ELSE 0 END AS start_s, CASE WHEN batch = 4 THEN NULL WHEN batch = 9 THEN -1e0 ELSE end_s END AS end_s, use, CASE WHEN batch < 9 THEN 'blurred' ELSE 'no' END AS reason,
   CASE WHEN batch = 10 THEN 'a boat' WHEN batch = 9 THEN NULL ELSE description END AS description, CASE WHEN batch = 5 THEN NULL ELSE subject_present END AS subject_present, story_potential + CASE WHEN batch = 8 THEN 3 ELSE 0 END AS story_potential,
   CASE WHEN batch = 7 THEN 'anger' ELSE emotion END AS emotion, notes, CASE WHEN batch = 6 THEN NULL ELSE 'sheet-1' END AS sheet, CASE WHEN batch % 5 = 0 THEN NULL ELSE yaw END AS yaw, yaw - 200 AS pitch, yaw / 2 AS fov, yaw / 300 AS focus_x, (yaw - 20) / 300 AS focus_y,
   CAST(hook - 1 AS DOUBLE) AS fps, start_s - 5 AS duration_s, CASE WHEN batch = 3 THEN 'wide' ELSE 'vertical' END AS framing, CASE WHEN batch = 4 THEN 'jumpy' WHEN batch < 8 THEN 'static' END AS live_motion"""
_MO_ARRAYS = """CASE batch WHEN 8 THEN NULL WHEN 2 THEN {l}'sky', 'sky'{r} WHEN 1 THEN {l}'sky', 'clouds', 'mud'{r} WHEN 0 THEN {e} ELSE {l}'sky', 'city'{r} END AS tags,
   CASE WHEN hook > 3 AND reaction THEN CASE batch WHEN 10 THEN {l}'fog'{r} WHEN 11 THEN {l}'glass', 'glass'{r} ELSE {l}'glass'{r} END END AS obstructions, CASE WHEN batch = 6 THEN {l}'id', 'colour', 'path', 'mood'{r} ELSE {l}'id', 'path', 'type'{r} END AS keys"""
_MO = f"(SELECT {_MO_FIELDS}, {_MO_ARRAYS.format(l='[', r=']', e='[]::VARCHAR[]')} FROM moments) z"
_IN = {n: ", ".join(repr(x) for x in v) for n, v in dict(tags=C.TAGS, obstructions=C.OBSTRUCTIONS, emotions=C.EMOTIONS, keys=C.ITEM_KEYS).items()}


def _each(name, col, allowed):
    return f" UNION ALL SELECT project_id, id, '{name}', CAST(n AS INT) FROM (SELECT project_id, id, unnest({col}) AS x, generate_subscripts({col}, 1) - 1 AS n FROM {_MO}) y WHERE x NOT IN ({allowed})"


_USED = "coalesce(use, TRUE)"


@query("DQ-01", ["moments"], rules(_MO, "project_id, id", ("id_pattern", "NOT regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$')", "NULL"), ("path_private", "regexp_matches(path, '^(/Users/|/home/|/root/)')", "NULL"), ("path_missing", "path IS NULL OR path = ''", "NULL"),
       ("type_vocabulary", "type NOT IN ('photo', 'video', 'video360', 'live')", "NULL"), ("date_format", r"NOT regexp_matches(date, '^\d{4}-\d{2}-\d{2}')", "NULL"), ("quality_range", "quality NOT BETWEEN 1 AND 5", "NULL"), ("hook_range", "hook NOT BETWEEN 1 AND 5", "NULL"),
       ("start_negative", "start_s < 0", "NULL"), ("story_range", "story_potential NOT BETWEEN 0 AND 5", "NULL"), ("emotion_vocabulary", f"emotion NOT IN ({_IN['emotions']})", "NULL"), ("video_window", "type IN ('video', 'video360') AND (start_s IS NULL OR end_s IS NULL)", "NULL"),
       ("dropped_reason", f"NOT {_USED} AND (reason IS NULL OR length(reason) < 3)", "NULL"), *[(f"needs_{n}", f"{_USED} AND {c} IS NULL", "NULL") for n, c in (("description", "description"), ("quality", "quality"), ("hook", "hook"), ("subject", "subject_present"), ("sheet", "sheet"), ("tags", "tags"))],
       ("tags_empty", "len(tags) = 0", "NULL"), ("tags_repeat", "len(tags) <> len(list_distinct(tags))", "NULL"), ("sphere_direction", f"type = 'video360' AND {_USED} AND yaw IS NULL", "NULL"), ("yaw_range", "yaw NOT BETWEEN -360 AND 360", "NULL"),
       *sql_outside(pitch=(-90, 90), fov=(10, 180), focus_x=(0, 1), focus_y=(0, 1), fps=(1, None), end_s=(0, None), duration_s=(0, None)), *sql_shorter(description=12),
       *sql_words(framing=("vertical", "horizontal", "square"), live_motion=("subject", "camera", "static", "shaky", "short", "unreadable")), ("obstructions_repeat", "len(obstructions) <> len(list_distinct(obstructions))", "NULL"),
       ("obstruction_notes", "len(obstructions) > 0 AND notes IS NULL", "NULL"), ("obstruction_quality", "len(obstructions) > 0 AND quality > 2", "NULL"))
       + _each("tag_vocabulary", "tags", _IN["tags"]) + _each("obstruction_vocabulary", "obstructions", _IN["obstructions"]) + _each("unknown_key", "keys", _IN["keys"]))
def _(t):
    arrays = _MO_ARRAYS.format(l="array(", r=")", e="cast(array() AS array<string>)")
    return C.check_moments(t.spark.sql(f"SELECT {_MO_FIELDS}, {arrays} FROM {{m}}", m=t.moments))


@query("AG-23", ["c_blocks", "c_head"], """SELECT concept_id AS variant_id, cuts, subject_cuts, subject_cuts / cuts AS ratio, subject_cuts / cuts <= max_ratio + 1e-9 AND (min_ratio IS NULL OR subject_cuts / cuts >= min_ratio - 1e-9) AS pass
   FROM (SELECT concept_id, count(*) AS cuts, count(*) FILTER (subject) AS subject_cuts FROM c_blocks GROUP BY 1) b JOIN c_head USING (concept_id)""")
def _(t):
    return C.quota(t.c_blocks.withColumnRenamed("concept_id", "variant_id"), t.c_head.select(F.col("concept_id").alias("variant_id"), "max_ratio", "min_ratio")).drop("max_ratio", "min_ratio")


@query("AG-25", ["c_head"], """SELECT g.*, shortest, longest, longest - shortest < 5 AS within_5s, longest - shortest < 10 AS within_10s FROM (SELECT project_id, CAST(sum(n) AS BIGINT) AS concepts, count(*) AS families, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_repeated_family
   FROM (SELECT project_id, family, count(*) AS n FROM c_head GROUP BY 1, 2) a GROUP BY 1) g JOIN (SELECT project_id, min(picture_s) AS shortest, max(picture_s) AS longest FROM c_head GROUP BY 1) d USING (project_id)""")
def _(t):
    return C.variety(t.c_head, t.c_head.select("project_id", F.col("picture_s").alias("duration_s")))


@query("JN-30", ["c_blocks", "c_head"], "SELECT project_id, resource, count(DISTINCT b.concept_id) AS concepts, min(b.concept_id) AS first_concept, max(b.concept_id) AS last_concept FROM c_blocks b JOIN c_head h USING (concept_id) GROUP BY 1, 2 HAVING count(DISTINCT b.concept_id) > 1")
def _(t):
    return C.shared_resources(t.c_blocks, t.c_head)


@query("AG-26", ["variant_results"], "SELECT concept_id, count(*) FILTER (verify_pass AND coalesce(deliverable, TRUE)) AS delivered, count(*) FILTER (NOT (verify_pass AND coalesce(deliverable, TRUE))) AS blocked, count(*) FILTER (skipped <> '') AS with_skips, min(duration_s) AS shortest, max(duration_s) AS longest FROM variant_results GROUP BY 1")
def _(t):
    return C.delivery(t.variant_results)


@query("SO-05", ["reviews", "fixes", "variant_results"], """SELECT concept_id, letter, 'story' AS origin, what FROM fixes WHERE level = 'blocks' UNION ALL SELECT concept_id, letter, 'review', 'review problem' FROM reviews WHERE severity = 'blocks'
   UNION ALL SELECT concept_id, letter, 'gate', 'it does not pass the delivery gate' FROM variant_results WHERE NOT verify_pass AND coalesce(deliverable, TRUE)
   UNION ALL SELECT concept_id, letter, 'rubric', 'it scores ' || rubric_total FROM variant_results v WHERE rubric_total < 65 AND NOT EXISTS (SELECT 1 FROM fixes f WHERE f.level = 'blocks' AND f.concept_id = v.concept_id AND f.letter = v.letter)""")
def _(t):
    return C.blockers(t.reviews, t.fixes, t.variant_results)


@query("JN-28", ["variant_results", "repairs"], "SELECT concept_id, letter, CASE WHEN r.letter IS NOT NULL THEN r.verify_pass ELSE b.verify_pass END AS verify_pass, CASE WHEN r.letter IS NOT NULL THEN r.rubric_total ELSE b.rubric_total END AS rubric_total, r.letter IS NOT NULL AS repaired FROM variant_results b FULL JOIN repairs r USING (concept_id, letter)")
def _(t):
    return C.merge_fixed(t.variant_results, t.repairs)
