"""Timed text queries."""
from pyspark.sql import Window, functions as F

from framelake.operators import text as X, video as Vd
from framelake.queries.posts import PRIVATE_KIND
from framelake.registry import ORACLES, oracle_text, query
from framelake.sources import readers as R  # noqa: F401

def r9(df, *cols, n=9):
    for x in cols:
        df = df.withColumn(x, F.round(x, n))
    return df


_FOLD = "translate(lower({t}), 'áàäâéèëêíìïîóòöôúùüûñç', 'aaaaeeeeiiiioooouuuunc')"


@query("PRJ-08", ["lines"], """SELECT doc_id, n, round_even(w / CASE lang WHEN 'en' THEN 2.8::DOUBLE WHEN 'fr' THEN 2.7::DOUBLE WHEN 'de' THEN 2.4::DOUBLE WHEN 'it' THEN 2.7::DOUBLE ELSE 2.6::DOUBLE END + CASE WHEN m > 0 THEN m ELSE 1 END * 0.28::DOUBLE, 2) AS speech_s FROM (
   SELECT doc_id, n, lang, len(regexp_extract_all(text, '[^\\s\\pZ]+')) AS w, len(regexp_extract_all(text, '[.!?…]+')) AS m FROM lines) s""")
def _(t):
    return X.estimate_speech(t.lines).select("doc_id", "n", "speech_s")


@query("PRJ-09", ["lines"], f"SELECT doc_id, n, CAST(k AS INT) AS pos, token FROM (SELECT doc_id, n, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS k FROM (SELECT doc_id, n, regexp_extract_all({_FOLD.format(t='text')}, '[a-z0-9]{{3,}}') AS a FROM lines) s) z")
def _(t):
    return X.tokens(t.lines, keep=("doc_id", "n"))


@query("PRJ-13", ["tracks"], """SELECT page_id, CASE WHEN r IN ('voice', 'narration', 'vo', 'tts') THEN 'voice' WHEN r IN ('sfx', 'fx', 'effect', 'hit') THEN 'sfx' WHEN r <> '' THEN 'bed'
   WHEN regexp_matches(s, '(^|/)l[0-9]+\\.wav$') OR regexp_matches(s, 'voice|narration|narracion|narração|narracao|voz|tts') THEN 'voice' WHEN contains(s, '/sfx/') THEN 'sfx' ELSE 'bed' END AS track_role
   FROM (SELECT page_id, lower(trim(coalesce(role, ''))) AS r, lower(coalesce(src, '')) AS s FROM tracks) z""")
def _(t):
    return X.track_roles(t.tracks).select("page_id", "track_role")


_LOOK = """(SELECT *, CASE WHEN tag = 'food' THEN 'food-warm' WHEN luma < 0.3 AND dark > 0.35 AND neon > 0.02 THEN 'neon-night' WHEN luma < 0.3 AND dark > 0.35 THEN 'night-city' WHEN snow > 0.18 AND luma > 0.55 THEN 'alpine-snow'
   WHEN luma > 0.25 AND autumn >= green AND autumn >= wt AND autumn >= 0.15 THEN 'autumn-moody' WHEN luma > 0.25 AND NOT (autumn >= green AND autumn >= wt) AND green >= wt AND green >= 0.1 THEN 'forest-deep'
   WHEN luma > 0.25 AND NOT (autumn >= green AND autumn >= wt) AND green < wt AND wt >= 0.1 THEN 'tropical-water'
   WHEN warm_cast > 0.1 AND luma > 0.35 AND sky_blue < 0.2 AND (tag = 'interior' OR (sky_grey < 0.05 AND sky_blue < 0.02 AND luma < 0.5)) THEN 'interior-warm' WHEN warm_cast > 0.1 AND luma > 0.35 AND sky_blue < 0.2 THEN 'golden-hour'
   WHEN sky_grey > 0.35 THEN 'overcast-film' ELSE 'urban-clean' END AS look FROM (SELECT *, water + CASE WHEN tag = 'water' THEN 0.05::DOUBLE ELSE 0 END AS wt FROM scene_features) a)"""


@query("PRJ-14", ["scene_features"], f"SELECT video_id, i, look FROM {_LOOK} z")
def _(t):
    return X.classify_scene(t.scene_features).select("video_id", "i", "look")


@query("AG-17", ["scene_features"], f""", k AS (SELECT *, CASE WHEN look IN ('night-city', 'neon-night') THEN 'night' ELSE 'day' END AS side FROM {_LOOK} z),
   w AS (SELECT video_id, side, look, row_number() OVER (PARTITION BY video_id, side ORDER BY round_even(sum(dur), 6) DESC, min(i)) AS r FROM k GROUP BY 1, 2, 3) SELECT k.video_id, k.i, k.side, w.look FROM k JOIN w ON w.video_id = k.video_id AND w.side = k.side AND w.r = 1""")
def _(t):
    return Vd.unify_look(X.classify_scene(t.scene_features)).select("video_id", "i", "side", "look")


_TOK = r"[\pL\pN_]+|[^\pL\pN_]"


@query("PRJ-15", ["lines", "lexicons"], rf""", lex AS (SELECT lang, lower(term) AS run, arg_max(say, layer) AS say FROM lexicons WHERE term <> '' GROUP BY 1, 2),
   tk AS (SELECT doc_id, n, lang, text, regexp_extract_all(text, '{_TOK}') AS tok FROM lines), longest AS (SELECT max(len(regexp_extract_all(run, '{_TOK}'))) AS m FROM lex),
   wd AS (SELECT doc_id, n, lang, tok, unnest(range(1, len(tok) + 1)) AS a FROM tk), sp AS (SELECT doc_id, n, lang, tok, a, unnest(range(1, (SELECT m FROM longest) + 1)) AS k FROM wd),
   ok AS (SELECT doc_id, n, a, k, say FROM (SELECT *, lower(array_to_string(tok[a:a + k - 1], '')) AS run FROM sp WHERE a + k - 1 <= len(tok)
      AND (regexp_matches(tok[a], '^[\pL\pN_]') OR a = 1 OR NOT regexp_matches(tok[a - 1], '^[\pL\pN_]'))
      AND (regexp_matches(tok[a + k - 1], '^[\pL\pN_]') OR a + k - 1 = len(tok) OR NOT regexp_matches(tok[a + k], '^[\pL\pN_]'))) z JOIN lex USING (lang, run)
      QUALIFY row_number() OVER (PARTITION BY doc_id, n, a ORDER BY length(run) DESC) = 1),
   r(doc_id, n, a, k, say) AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY a) = 1
      UNION ALL SELECT o.doc_id, o.n, o.a, o.k, o.say FROM r JOIN ok o ON o.doc_id = r.doc_id AND o.n = r.n AND o.a >= r.a + r.k QUALIFY row_number() OVER (PARTITION BY o.doc_id, o.n ORDER BY o.a) = 1),
   out AS (SELECT wd.doc_id, wd.n, string_agg(CASE WHEN r.a IS NULL THEN tok[wd.a] WHEN r.a = wd.a THEN say ELSE '' END, '' ORDER BY wd.a) AS spoken
      FROM wd LEFT JOIN r ON r.doc_id = wd.doc_id AND r.n = wd.n AND r.a <= wd.a AND wd.a < r.a + r.k GROUP BY 1, 2)
   SELECT doc_id, n, coalesce(spoken, text) AS spoken FROM lines LEFT JOIN out USING (doc_id, n)""", recursive=True)
def _(t):
    return X.apply_lexicon(t.lines, t.lexicons, ["doc_id", "n"]).select("doc_id", "n", "spoken")


@query("PRJ-16", ["segments"])
def _(t):
    return r9(X.split_captions(t.segments, ("doc_id", "n")), "t0", "t1")


@query("PRJ-17", ["segments"], """, w AS (SELECT doc_id, n, t0, t1, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, n, t0, t1, list_filter(regexp_split_to_array(text, '[\\s\\pZ]+'), lambda x: x <> '') AS a FROM segments) z),
   r AS (SELECT *, coalesce(sum(CASE WHEN right(w, 1) IN (',', '.', '…', '?', '!') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM w),
   g AS (SELECT doc_id, n, t0, t1, run, p // 3 AS q, string_agg(w, ' ' ORDER BY pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n, run ORDER BY pos) - 1 AS p FROM r) x GROUP BY 1, 2, 3, 4, 5, 6),
   s AS (SELECT *, row_number() OVER o - 1 AS grp, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, n ORDER BY run, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, sum(length(text) + 2) OVER (PARTITION BY doc_id, n)::BIGINT AS m FROM g WINDOW o AS (PARTITION BY doc_id, n ORDER BY run, q))
   SELECT doc_id, n, CAST(grp AS INT) AS "group", text, round(t0 + (t1 - t0) * b / m, 9) AS t0, round(t0 + (t1 - t0) * (b + length(text) + 2) / m, 9) AS t1, CASE WHEN grp = 0 THEN t0 END AS audio_t0 FROM s""")
def _(t):
    k = X.karaoke(t.segments.withColumn("audio_t0", F.col("t0")), ["doc_id", "n"])
    return k.withColumn("t0", F.round("t0", 9)).withColumn("t1", F.round("t1", 9))


@query("FLT-08", ["segments"], "SELECT doc_id, n, avg_logprob, no_speech FROM segments WHERE avg_logprob < -0.8 OR no_speech > 0.5")
def _(t):
    return X.shaky(t.segments).select("doc_id", "n", "avg_logprob", "no_speech")


@query("FLT-09", ["words"], "SELECT script_id, segment, string_agg(w, ' ' ORDER BY pos) AS low_confidence FROM words WHERE p > 0 AND p < 0.5 GROUP BY 1, 2")
def _(t):
    return X.weak_words(t.words, ["script_id", "segment"]).withColumn("low_confidence", F.array_join("low_confidence", " "))


_TIMED = r"^\s*(?:\[\s*)?~?\s*(\d+(?:\.\d+)?)\s*(?:\])?\s*(?:s\b)?\s*(?:\|)?\s+(?:~?\s*[\d.]+\s*s?\s+)?(.+)$"


@query("SRC-05", ["script_rows"], rf""", l AS (SELECT script_id, n, regexp_replace(line, '\s+$', '') AS line FROM script_rows), st AS (SELECT script_id, min(n) AS stop FROM l WHERE regexp_matches(line, '(?i)^[#\s]*(notes?|notas?|observaciones|obs)\s*:?\s*$') OR regexp_matches(line, '(?i)^[#\s]*(optional|opcional|opcionais)\b') GROUP BY 1),
   a AS (SELECT l.* FROM l LEFT JOIN st USING (script_id) WHERE (stop IS NULL OR n < stop) AND trim(line) <> '' AND NOT regexp_matches(ltrim(line), '^(---|===|#)')),
   b AS (SELECT *, trim(trim(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_extract(line, '{_TIMED}', 2), ' |'), '\s{{2,}}[\d.]+\s*s\.?$', '')), '^(?:s\b|~?\s*[\d.]+\s*s\b|\d+)\s*', '')), '^~?\s*[\d.]+\s*s\b\s*', ''))), ' |' || chr(9)) AS x FROM a),
   c AS (SELECT *, CASE WHEN NOT regexp_matches(line, '{_TIMED}') THEN 'untimed' WHEN length(x) < 8 OR NOT regexp_matches(x, '\pL\pL\pL') THEN 'too_short'
      WHEN regexp_matches(lower(x), '^(line|in|dur|duration|video|optional|notes)') THEN 'heading' END AS dropped FROM b)
   SELECT script_id, n, CASE WHEN dropped IS NULL THEN CAST(regexp_extract(line, '{_TIMED}', 1) AS DOUBLE) END AS start_s, CASE WHEN dropped IS NULL THEN x END AS text, dropped FROM c""")
def _(t):
    return X.parse_scripts(t.script_rows)


@query("SRC-06", ["shots"], """SELECT video_id, i, t0, t1, dur, CAST(src AS VARCHAR) AS src, hero, CASE WHEN i % 3 = 1 THEN 'one phrase' WHEN i % 3 = 2 THEN 'one phrase|[and] another' END AS says FROM shots""")
def _(t):
    # a shot says nothing, one text or a list of texts, as files have it
    says = F.expr("""CASE WHEN i % 3 = 1 THEN parse_json('"one phrase"') WHEN i % 3 = 2 THEN parse_json('["one phrase", "[and] another"]') END""").alias("says")
    s = t.shots.groupBy("video_id").agg(F.max("t1").alias("duration"), F.collect_list(F.struct("i", "t0", "t1", "dur", F.col("src").cast("string").alias("src"), "hero", says)).alias("shots"))
    c = t.captions.groupBy("video_id").agg(F.collect_list(F.struct("t0", "t1", "text")).alias("captions"))
    docs = s.join(c, "video_id", "left").select("video_id", F.to_json(F.struct("duration", "shots", "captions")).alias("body"))
    return Vd.read_timelines(docs)[0].select("video_id", "i", "t0", "t1", "dur", "src", "hero", F.array_join("says", "|").alias("says"))


_SPEC = """SELECT video_id, i, round_even(t, 3) AS t0, round_even(t + d, 3) AS t1, round_even(d, 3) AS dur, string_split(src, '/')[-1] AS src, TRUE AS partial FROM (
   SELECT *, beat0 + coalesce(sum(d) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t, bool_or(d IS NULL) OVER (PARTITION BY video_id) AS bad FROM (SELECT *, CASE WHEN beats IS NOT NULL THEN beats * (60.0::DOUBLE / bpm) ELSE dur END AS d FROM spec_segments) a) b WHERE NOT bad"""


@query("SRC-07", ["spec_segments"], _SPEC)
def _(t):
    return Vd.timeline_from_spec(t.spec_segments)


@query("SRC-07-captions", ["spec_segments", "seg_captions"], f""", st AS ({_SPEC}), n AS (SELECT video_id, count(*) AS n FROM st GROUP BY 1),
   r AS (SELECT c.*, CASE WHEN seg_from < 0 THEN seg_from + n ELSE seg_from END AS a, CASE WHEN seg_to < 0 THEN seg_to + n ELSE seg_to END AS b FROM seg_captions c JOIN n USING (video_id)),
   j AS (SELECT r.video_id, r.i, CASE WHEN seg_from IS NULL THEN r.t0 ELSE x.t0 + coalesce(lead, 0) END AS t0, CASE WHEN seg_from IS NULL THEN r.t1 ELSE y.t1 + coalesce(tail, 0) END AS t1,
      CASE WHEN seg_from IS NULL THEN 'spec' ELSE 'cut' END AS source FROM r LEFT JOIN st x ON x.video_id = r.video_id AND x.i = r.a LEFT JOIN st y ON y.video_id = r.video_id AND y.i = r.b)
   SELECT video_id, i, t0, t1, source FROM j WHERE t0 IS NOT NULL AND t1 IS NOT NULL""")
def _(t):
    return Vd.captions_from_spec(t.seg_captions, t.spec_segments).select("video_id", "i", "t0", "t1", "source")


@query("SRC-08", ["talk_lines"], """SELECT video_id AS script_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INT) AS i, coalesce(start_s, 0) AS start_s, text, duration_s, TRUE AS duck FROM talk_lines""")
def _(t):
    n = lambda k, v: F.when(F.col("i") % 3 == k, F.col(v))
    item = F.struct("i", n(0, "start_s").alias("start_s"), n(1, "start_s").alias("t"), n(2, "start_s").alias("at"), "text", n(0, "duration_s").alias("duration_hint_s"), n(1, "duration_s").alias("dur"))
    docs = t.talk_lines.groupBy(F.col("video_id").alias("script_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("b"))
    docs = docs.select("script_id", F.when(F.col("script_id") % 2 == 0, F.col("b")).otherwise(F.concat(F.lit('{"lines":'), "b", F.lit("}"))).alias("body"))
    return X.read_voice_lines(docs)


_PH = """, x AS (SELECT *, lead(t0) OVER o AS nx FROM words WHERE w <> '' WINDOW o AS (PARTITION BY script_id ORDER BY segment, pos)),
   c AS (SELECT *, CASE WHEN right(rtrim(w), 1) IN ('.', '?', '!', '…', ':', ';', '。', '？', '！') OR coalesce(nx - t1, 0) >= 0.34 THEN 1 ELSE 0 END AS cl FROM x),
   f AS (SELECT *, coalesce(sum(cl) OVER (PARTITION BY script_id ORDER BY segment, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS phrase FROM c),
   ph AS (SELECT script_id, phrase, round_even(min(t0), 3) AS start, round_even(max(t1), 3) AS "end", count(*) AS words, string_agg(w, ' ' ORDER BY segment, pos) AS raw, round_even(avg(p), 3) AS confidence FROM f GROUP BY 1, 2),
   pa AS (SELECT *, round_even(coalesce(start - lag("end") OVER o, start), 3) AS pause_before, round_even(coalesce(lead(start) OVER o - "end", 0), 3) AS pause_after FROM ph WINDOW o AS (PARTITION BY script_id ORDER BY phrase)) """


@query("WN-09", ["words"], _PH + "SELECT script_id, phrase, start, \"end\", words, regexp_replace(trim(raw), '[\\s\\pZ]+([,.;:!?…])', '\\1', 'g') AS text FROM ph")
def _(t):
    return X.phrases(t.words).drop("confidence")


@query("WN-10", ["words"], _PH + "SELECT script_id, phrase, pause_before, pause_after FROM pa")
def _(t):
    return X.pauses_around(X.phrases(t.words)).select("script_id", "phrase", "pause_before", "pause_after")


_DB = "-10.0 - (cast(words as bigint) * 7 + phrase) % 30"


_PUNCH = _PH + f""", tt AS (SELECT script_id, max(t1) AS total_s FROM words GROUP BY 1), d AS (SELECT *, ({_DB})::DOUBLE AS mean_db FROM pa), m AS (SELECT script_id, median(mean_db) AS md FROM d GROUP BY 1),
   lp AS (SELECT script_id, max(pause_before) FILTER (phrase > 0) AS lp FROM d GROUP BY 1),
   s AS (SELECT d.script_id, d.phrase, d.start, d."end", 2.0::DOUBLE * CASE WHEN lp > 0.01 THEN pause_before / lp ELSE 0 END + 1.0::DOUBLE * least(greatest(0, mean_db - md) / 6.0::DOUBLE, 1.5::DOUBLE) + 0.6::DOUBLE * (start / total_s) AS score FROM d JOIN m USING (script_id) JOIN lp USING (script_id) JOIN tt USING (script_id)),
   r AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS nx, count(*) OVER (PARTITION BY script_id) AS n FROM s WINDOW o AS (PARTITION BY script_id ORDER BY score DESC, phrase)), b AS (SELECT *, CASE WHEN n > 1 THEN score - nx END AS margin FROM r WHERE r = 1) """


@query("WN-11", ["words"], _PUNCH + """SELECT script_id, phrase AS punch, start, "end", round(margin, 6) AS margin, CASE WHEN margin IS NULL OR margin >= 0.8 THEN 'high' WHEN margin >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def _(t):
    ph = X.pauses_around(X.phrases(t.words)).withColumn("mean_db", F.expr(_DB).cast("double"))
    tot = t.words.groupBy("script_id").agg(F.max("t1").alias("total_s"))
    return X.punchline(ph, tot).withColumn("margin", F.round("margin", 6))


@query("WN-11-roles", ["words"], _PUNCH + "SELECT d.script_id, d.phrase, CASE WHEN d.phrase < b.phrase THEN 'setup' WHEN d.phrase = b.phrase THEN 'punchline' ELSE 'tag' END AS role FROM d JOIN b USING (script_id)")
def _(t):
    ph = X.pauses_around(X.phrases(t.words)).withColumn("mean_db", F.expr(_DB).cast("double"))
    tot = t.words.groupBy("script_id").agg(F.max("t1").alias("total_s"))
    return X.phrase_roles(ph, X.punchline(ph, tot)).select("script_id", "phrase", "role")


@query("JN-32", ["words", "script_silences"], _PH + """, g AS (SELECT script_id, "end" AS start, round_even("end" + pause_after, 3) AS e FROM pa WHERE pause_after >= 0.34)
   SELECT script_id, start, e AS "end", 'speech_gap' AS kind FROM g UNION ALL SELECT script_id, start, e, 'silence' FROM script_silences s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.script_id = s.script_id AND abs(s.start - g.start) < 0.2 - 1e-9)""")
def _(t):
    return X.pauses(X.pauses_around(X.phrases(t.words)), t.script_silences.withColumnRenamed("e", "end"))


@query("WN-13", ["text_samples"], """SELECT clip_id, run, min(t) AS "from", max(t) AS "to", any_value(x) AS text, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY clip_id ORDER BY t)::BIGINT AS run FROM (
   SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER (PARTITION BY clip_id ORDER BY t) THEN 1 ELSE 0 END AS f FROM (SELECT clip_id, t, coalesce(text, '') AS x FROM text_samples) a) b) c GROUP BY 1, 2 HAVING any_value(x) <> ''""")
def _(t):
    return X.text_runs(t.text_samples, ["clip_id"], ["t"])


@query("WN-22", ["captions"], """, n AS (SELECT *, lead(t0) OVER (PARTITION BY video_id ORDER BY t0, i) AS nx FROM captions), a AS (SELECT *, CASE WHEN t1 - t0 < 0.7 THEN round_even(least(greatest(t0 + 0.7::DOUBLE, t1), greatest(coalesce(nx, t1 + 0.7::DOUBLE), t1)), 3) ELSE t1 END AS e FROM n)
   SELECT video_id, i, t0, CASE WHEN nx IS NULL THEN e ELSE round_even(least(e, greatest(t0 + 0.25::DOUBLE, nx)), 3) END AS t1 FROM a""")
def _(t):
    return X.tidy_captions(t.captions).select("video_id", "i", "t0", "t1")


@query("WN-24", ["captions"], """, c AS (SELECT *, i % 7 <> 3 AS card FROM captions) SELECT c.video_id, c.i, CASE WHEN card AND style <> 'pin' AND NOT pin THEN f.s ELSE style END AS style FROM c LEFT JOIN (
   SELECT video_id, arg_min(style, (t0, i)) AS s FROM c WHERE card GROUP BY 1) f ON f.video_id = c.video_id""")
def _(t):
    c = t.captions.withColumn("source", F.when(F.col("i") % 7 == 3, "sync")).withColumn("keep_style", F.col("pin"))
    return X.unify_text(c).select("video_id", "i", "style")


@query("WN-08", ["timed_lines", "totals"], """SELECT video_id AS script_id, i, "check" FROM (SELECT t.*, lead(start_s) OVER (PARTITION BY t.video_id ORDER BY i) AS nx, total_s FROM timed_lines t JOIN totals USING (video_id)) s,
   LATERAL (SELECT unnest(['out_of_order', 'two_voices', 'past_the_end']) AS "check") u WHERE ("check" = 'out_of_order' AND nx <= start_s) OR ("check" = 'two_voices' AND duration_s <> 0 AND start_s + duration_s > nx + 1e-9) OR ("check" = 'past_the_end' AND total_s > 0 AND start_s >= total_s)""")
def _(t):
    d = t.timed_lines.join(t.totals, "video_id").withColumnRenamed("video_id", "script_id")
    return X.line_overlaps(d, end_s="total_s")


@query("WN-25", ["talk_lines", "heard"], """, a AS (SELECT video_id, i, coalesce(start_s, round_even(coalesce(sum(d) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3)) AS "at", d FROM (SELECT *, coalesce(duration_s, 0.9::DOUBLE) AS d FROM talk_lines) z),
   w AS (SELECT video_id, i, string_agg(w, ' ' ORDER BY pos) AS text_heard, max(pos * 0.3::DOUBLE + 0.25::DOUBLE) AS e FROM heard WHERE ok GROUP BY 1, 2)
   SELECT a.video_id AS script_id, a.i, "at", coalesce(text_heard, '') AS text_heard, round_even("at" + e, 3) AS last_end, coalesce(round_even("at" + e, 3) > round_even("at" + d, 3) + 0.05::DOUBLE, FALSE) AS beyond_audio FROM a LEFT JOIN w ON w.video_id = a.video_id AND w.i = a.i""")
def _(t):
    lines = t.talk_lines.withColumn("duration_s", F.coalesce("duration_s", F.lit(0.9))).withColumnRenamed("video_id", "script_id")
    words = t.heard.filter("ok").selectExpr("video_id as script_id", "i", "pos", "w", "pos * 0.3D as t0", "pos * 0.3D + 0.25D as t1", "1.0D as p")
    return X.word_marks(lines, words).select("script_id", "i", "at", "text_heard", "last_end", "beyond_audio")


@query("WN-29", ["words"])
def _(t):
    lines = t.words.groupBy("script_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("w").alias("text"), "t0", "t1"))), lambda x: F.struct(x["text"].alias("text"), x["t0"].alias("t0"), x["t1"].alias("t1"))).alias("words"))
    return X.group_captions(lines)


@query("WN-28", ["ocr_words"])
def _(t):
    return X.private_text(t.ocr_words)


@query("WN-27", ["ev"])
def _(t):
    return r9(X.smooth_track(t.ev.selectExpr("user_id * 1000000 + cast(floor(event_id / 400) as bigint) as track", "cast(event_id as double) as t", "value as x")), "smooth", n=6)


# ---- sequential rules as recursive SQL -------------------------------------------------------------
def recursive(uses, body):
    return "WITH RECURSIVE " + oracle_text(uses, "").removeprefix("WITH ") + body


ORACLES["PRJ-16"] = recursive(["segments"], r""", s AS (SELECT doc_id, n, t0, t1, trim(regexp_replace(text, '[\s\x0b\x85\pZ]+', ' ', 'g')) AS t FROM segments), l AS (SELECT * FROM s WHERE t <> '' AND NOT (length(t) <= 42 AND t1 - t0 <= 3.2::DOUBLE)),
  w AS (SELECT doc_id, n, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS p FROM l),
  r(doc_id, n, p, c, len) AS (SELECT doc_id, n, 1::BIGINT, 0, length(w) FROM w WHERE p = 1 UNION ALL SELECT r.doc_id, r.n, w.p, CASE WHEN r.len + 1 + length(w.w) > 42 THEN r.c + 1 ELSE r.c END, CASE WHEN r.len + 1 + length(w.w) > 42 THEN length(w.w) ELSE r.len + 1 + length(w.w) END FROM r JOIN w ON w.doc_id = r.doc_id AND w.n = r.n AND w.p = r.p + 1),
  k AS (SELECT r.doc_id, r.n, r.c AS piece, string_agg(w.w, ' ' ORDER BY r.p) AS text FROM r JOIN w ON w.doc_id = r.doc_id AND w.n = r.n AND w.p = r.p GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, n, 0, t FROM s WHERE t <> '' AND length(t) <= 42 AND t1 - t0 <= 3.2::DOUBLE),
  b AS (SELECT k.*, s.t0 AS a0, s.t1 AS a1, coalesce(sum(length(text) + 1) OVER (PARTITION BY k.doc_id, k.n ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, sum(length(text) + 1) OVER (PARTITION BY k.doc_id, k.n)::BIGINT AS m FROM k JOIN s ON s.doc_id = k.doc_id AND s.n = k.n)
  SELECT doc_id, n, CAST(piece AS INT) AS piece, round(a0 + (a1 - a0) * b / m, 9) AS t0, round(least(a1, a0 + (a1 - a0) * (b + length(text) + 1) / m), 9) AS t1, text FROM b""")
ORACLES["WN-29"] = recursive(["words"], """, w AS (SELECT *, row_number() OVER (PARTITION BY script_id, segment ORDER BY pos) AS n FROM words),
  r(script_id, segment, n, g, c, len, s0, shut) AS (SELECT script_id, segment, n, 0, 1, length(w), t0, FALSE FROM w WHERE n = 1
    UNION ALL SELECT script_id, segment, n, CASE WHEN fresh THEN g + 1 ELSE g END, CASE WHEN fresh THEN 1 ELSE c + 1 END, CASE WHEN fresh THEN length(w) ELSE len + 1 + length(w) END, CASE WHEN fresh THEN t0 ELSE s0 END, NOT fresh AND (c + 1 >= 3 OR right(w, 1) IN (',', '.', '…', '?', '!', ':', ';'))
    FROM (SELECT w.script_id, w.segment, w.n, w.w, w.t0, r.g, r.c, r.len, r.s0, r.shut OR r.len + 1 + length(w.w) > 42 OR w.t1 - r.s0 > 3.2::DOUBLE AS fresh FROM r JOIN w ON w.script_id = r.script_id AND w.segment = r.segment AND w.n = r.n + 1) q)
  SELECT r.script_id, r.segment, CAST(g AS INT) AS g, round_even(min(t0), 3) AS t0, round_even(max(t1), 3) AS t1, string_agg(w, ' ' ORDER BY r.n) AS text FROM r JOIN w ON w.script_id = r.script_id AND w.segment = r.segment AND w.n = r.n GROUP BY 1, 2, 3""")
ORACLES["WN-27"] = recursive(["ev"], """, x AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, x) AS n FROM (SELECT user_id * 1000000 + event_id // 400 AS track, event_id::DOUBLE AS t, value AS x FROM ev) a),
  r(track, n, t, p, s) AS (SELECT track, n, t, x, 0.0::DOUBLE FROM x WHERE n = 1 UNION ALL SELECT track, n, t, CASE WHEN dt > 0 THEN p + dt / (dt + 1 / (2 * pi() * (0.4::DOUBLE + 0.02::DOUBLE * abs(s)))) * (x - p) ELSE p END, s
    FROM (SELECT x.track, x.n, x.t, x.x, r.p, x.t - r.t AS dt, CASE WHEN x.t > r.t THEN r.s + (x.t - r.t) / (x.t - r.t + 1 / (2 * pi())) * ((x.x - r.p) / (x.t - r.t) - r.s) ELSE r.s END AS s FROM r JOIN x ON x.track = r.track AND x.n = r.n + 1) q)
  SELECT track, t, round(p, 6) AS smooth FROM r""")
ORACLES["WN-28"] = recursive(["ocr_words"], f""", w AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round_even((y0 + y1) / 2, 2), x0, text, y0, x1, y1) AS n FROM ocr_words WHERE conf >= 0.5),
  r(frame, n, g, text, x0, y0, x1, y1) AS (SELECT frame, n, 0, text, x0, y0, x1, y1 FROM w WHERE n = 1
    UNION ALL SELECT frame, n, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN pt || ' ' || text ELSE text END, CASE WHEN near THEN px0 ELSE x0 END, CASE WHEN near THEN least(py0, y0) ELSE y0 END, x1, CASE WHEN near THEN greatest(py1, y1) ELSE y1 END
    FROM (SELECT w.*, r.g, r.text AS pt, r.x0 AS px0, r.y0 AS py0, r.y1 AS py1, abs((r.y0 + r.y1) / 2 - (w.y0 + w.y1) / 2) < greatest(r.y1 - r.y0, w.y1 - w.y0) * 0.6::DOUBLE AND w.x0 - r.x1 >= 0 AND w.x0 - r.x1 < greatest(r.y1 - r.y0, w.y1 - w.y0) * 2.5::DOUBLE AS near
          FROM r JOIN w ON w.frame = r.frame AND w.n = r.n + 1) q),
  l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY frame, g ORDER BY n DESC) = 1), k AS (SELECT *, {PRIVATE_KIND} AS kind FROM l)
  SELECT frame, kind, text, round_even((x0 + x1) / 2, 3) AS cx, round_even((y0 + y1) / 2, 3) AS cy FROM k WHERE kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY frame, kind, regexp_replace(text, '[^\\pL\\pN_]', '', 'g') ORDER BY y0, x0, text, x1, y1) = 1""")
