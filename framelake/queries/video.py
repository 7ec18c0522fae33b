"""Timeline queries: windows, cut grids, text and voice against the picture."""
from pyspark.sql import functions as F

from framelake.operators import video as V
from framelake.registry import query


def r6(df, *cols):
    for x in cols:
        df = df.withColumn(x, F.round(x, 6))
    return df


@query("JN-25", ["seg_captions", "shots"], """, n AS (SELECT video_id, count(*) AS n FROM shots GROUP BY 1), r AS (SELECT c.*, CASE WHEN seg_from < 0 THEN seg_from + n ELSE seg_from END AS a, CASE WHEN seg_to < 0 THEN seg_to + n ELSE seg_to END AS b FROM seg_captions c JOIN n ON n.video_id = c.video_id),
   j AS (SELECT r.video_id, r.i, seg_from, x.t0 AS s0, y.t1 AS s1, CASE WHEN seg_from IS NULL THEN r.t0 ELSE x.t0 + coalesce(lead, 0) END AS t0, CASE WHEN seg_from IS NULL THEN r.t1 ELSE y.t1 + coalesce(tail, 0) END AS t1 FROM r LEFT JOIN shots x ON x.video_id = r.video_id AND x.i = r.a LEFT JOIN shots y ON y.video_id = r.video_id AND y.i = r.b)
   SELECT video_id, i, t0, t1, CASE WHEN seg_from IS NOT NULL AND (s0 IS NULL OR s1 IS NULL) THEN 'no such segment' WHEN t0 IS NULL OR t1 IS NULL THEN 'neither seconds nor segment' WHEN t1 <= t0 THEN 'ends before it starts' END AS error FROM j""")
def _(t):
    return V.anchor_captions(t.seg_captions, t.shots).select("video_id", "i", "t0", "t1", "error")


@query("JN-26", ["clip_subs", "clip_segs"], """SELECT video_id, i, sub, round(t0, 6) AS t0, round(least(g1, greatest(t1, t0 + 0.7::DOUBLE)), 6) AS t1, text FROM (SELECT g.video_id, g.i, g.g1, s.sub, s.text, greatest(g0, g0 + (s.t0 - start_s) / speed) AS t0, least(g1, g0 + (s.t1 - start_s) / speed) AS t1
   FROM clip_segs g JOIN clip_subs s ON s.src = g.src) x WHERE t1 - t0 >= 0.2""")
def _(t):
    return r6(V.segment_subtitles(t.clip_subs, t.clip_segs).select("video_id", "i", "sub", "t0", "t1", "text"), "t0", "t1")


_MERGED = """(SELECT video_id, "window", round_even(min(a), 3) AS t0, round_even(max(b), 3) AS t1 FROM (SELECT *, sum(f) OVER (PARTITION BY video_id ORDER BY a, b ROWS UNBOUNDED PRECEDING)::BIGINT AS "window" FROM (
   SELECT *, CASE WHEN p IS NULL OR a - p > 0.5 THEN 1 ELSE 0 END AS f FROM (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (
   SELECT v.video_id, greatest(0, t0 - 0.15::DOUBLE) AS a, least(t1 + 0.35::DOUBLE, total_s) AS b FROM voice_lines v JOIN totals USING (video_id)) q) x) y) z GROUP BY 1, 2 HAVING round_even(max(b), 3) > round_even(min(a), 3))"""


def _merged(t):
    return V.merge_windows(t.voice_lines.join(t.totals, "video_id"), 0.5, total="total_s", lead=0.15, tail=0.35)


@query("WN-14", ["voice_lines", "totals"], f"SELECT * FROM {_MERGED} m")
def _(t):
    return _merged(t)


@query("WN-15", ["voice_lines", "totals"], f""", g AS (SELECT *, coalesce(max(t1) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM {_MERGED} m), e AS (SELECT t.video_id, total_s, coalesce(max(t1), 0) AS c FROM totals t LEFT JOIN {_MERGED} m USING (video_id) GROUP BY 1, 2)
   SELECT video_id, round(c + 0.4::DOUBLE, 6) AS g0, round(t0 - 0.4::DOUBLE, 6) AS g1 FROM g WHERE t0 - c > 1 UNION ALL SELECT video_id, round(c + 0.4::DOUBLE, 6), round(total_s - 0.4::DOUBLE, 6) FROM e WHERE total_s - c > 1""")
def _(t):
    return r6(V.complement(_merged(t), t.totals), "g0", "g1")


_SIL = """(SELECT video_id, round(s0, 6) AS s0, round(s1, 6) AS s1 FROM (SELECT e.video_id, kind, lag(kind) OVER w AS k, greatest(0, lag(t) OVER w) AS s0, t AS s1, total_s FROM silence_events e JOIN totals USING (video_id) WINDOW w AS (PARTITION BY e.video_id ORDER BY t, kind)) a
     WHERE kind = 'end' AND k = 'start' AND s1 - s0 >= 0.6 AND s0 < greatest(0, total_s - 1)
   UNION ALL SELECT video_id, round(greatest(0, t), 6), round(total_s, 6) FROM (SELECT e.*, total_s, lead(kind) OVER (PARTITION BY e.video_id ORDER BY t, kind) AS nx FROM silence_events e JOIN totals USING (video_id)) b WHERE kind = 'start' AND nx IS NULL AND greatest(0, t) < greatest(0, total_s - 1))"""


@query("WN-17", ["silence_events", "totals"], f"SELECT * FROM {_SIL} s")
def _(t):
    return r6(V.pair_silences(t.silence_events, t.totals), "s0", "s1")


@query("WN-15-phrases", ["silence_events", "totals"], f""", s AS (SELECT * FROM {_SIL} z), c AS (SELECT *, coalesce(max(s1) OVER (PARTITION BY video_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM s),
   g AS (SELECT video_id, c AS g0, s0 AS g1 FROM c WHERE s0 - c > 0.25::DOUBLE UNION ALL
      SELECT t.video_id, coalesce(e, 0), total_s FROM totals t LEFT JOIN (SELECT video_id, max(s1) AS e FROM s GROUP BY 1) m USING (video_id) WHERE total_s - coalesce(e, 0) > 0.25::DOUBLE),
   p AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY g0) - 1 AS INT) AS phrase, round_even(g0, 3) AS start, round_even(g1, 3) AS "end", round_even(g1 - g0, 3) AS dur FROM g)
   SELECT *, round_even(coalesce(start - lag("end") OVER w, start), 3) AS pause_before, round_even(coalesce(lead(start) OVER w - "end", 0), 3) AS pause_after FROM p WINDOW w AS (PARTITION BY video_id ORDER BY phrase)""")
def _(t):
    return V.silence_phrases(r6(V.pair_silences(t.silence_events, t.totals), "s0", "s1"), t.totals)


@query("WN-15-band", ["ocr_words"], """, b AS (SELECT frame, greatest(0, y0) AS t0, least(1, y1) AS t1 FROM ocr_words), g AS (
   SELECT frame, t0 - coalesce(max(t1) OVER (PARTITION BY frame ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM b UNION ALL SELECT frame, 1 - greatest(0, max(t1)) FROM b GROUP BY 1)
   SELECT frame, round_even(max(d), 3) AS clear_band FROM g WHERE d > 0 GROUP BY 1""")
def _(t):
    return V.clear_band(t.ocr_words.select("frame", F.col("y0").alias("t0"), F.col("y1").alias("t1")), ["frame"])


@query("WN-26", ["totals", "shots"], """, k AS (SELECT video_id, total_s AS dur, CASE WHEN total_s <= 35 THEN 0.5::DOUBLE WHEN total_s <= 100 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS step, greatest(0, total_s - 1 / 30.0::DOUBLE) AS last FROM totals),
   g AS (SELECT video_id, round_even(j * step, 2) AS t, step, last FROM (SELECT *, unnest(range(CAST(floor(last / step) AS BIGINT) + 1)) AS j FROM k) x), g2 AS (SELECT video_id, t FROM g UNION ALL SELECT video_id, round_even(last, 2) FROM k WHERE last - floor(last / step) * step > 0.05)
   SELECT video_id, t FROM g2 UNION SELECT s.video_id, least(round_even((t0 + t1) / 2, 2), last) FROM shots s JOIN k USING (video_id) WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.video_id = s.video_id AND g2.t >= s.t0 AND g2.t < s.t1)""")
def _(t):
    clips = t.totals.select("video_id", F.col("total_s").alias("dur"), F.lit(30.0).alias("fps"))
    return V.sample_plan(clips, t.shots)


_GRID = """, n AS (SELECT variant_id, max(i) AS last FROM edit_shots GROUP BY 1), RECU AS (
   SELECT variant_id, -1 AS i, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1 FROM n
   UNION ALL SELECT s.variant_id, s.i, g.t1, CASE WHEN s.line IS NOT NULL THEN CASE WHEN s.dur IS NOT NULL THEN g.t1 + s.dur WHEN m.bpm IS NOT NULL THEN m.beat0 + ceil((g.t1 + (CASE WHEN s.i = 0 THEN 0.0::DOUBLE ELSE 0.14::DOUBLE END + s.line_s + CASE WHEN s.i = n.last THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END) - m.beat0) / (60.0::DOUBLE / m.bpm / 2) - 1e-6) * (60.0::DOUBLE / m.bpm / 2)
        ELSE g.t1 + (CASE WHEN s.i = 0 THEN 0.0::DOUBLE ELSE 0.14::DOUBLE END + s.line_s + CASE WHEN s.i = n.last THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END) END
      WHEN m.bpm IS NOT NULL AND s.beats IS NOT NULL THEN CASE WHEN s.i = 0 THEN m.beat0 + s.beats * (60.0::DOUBLE / m.bpm) ELSE m.beat0 + ceil((g.t1 - m.beat0) / (60.0::DOUBLE / m.bpm) - 1e-6) * (60.0::DOUBLE / m.bpm) + s.beats * (60.0::DOUBLE / m.bpm) END
      ELSE g.t1 + s.dur END
   FROM g JOIN edit_shots s ON s.variant_id = g.variant_id AND s.i = g.i + 1 JOIN music m ON m.variant_id = s.variant_id JOIN n ON n.variant_id = s.variant_id)"""
_GRID = "WITH RECURSIVE " + "{head}" + _GRID.replace("RECU AS", "g(variant_id, i, t0, t1) AS")


def _rec(uses, tail):
    from framelake.registry import oracle_text
    head = oracle_text(uses, "").removeprefix("WITH ")
    return _GRID.replace("{head}", head) + tail


def _grid(t):
    # a seconds grid needs a length for every shot
    shots = t.edit_shots.join(t.music.select("variant_id", "bpm"), "variant_id").withColumn("dur", F.when(F.col("bpm").isNull() & F.col("line").isNull(), F.coalesce("dur", F.lit(1.5))).otherwise(F.col("dur"))).drop("bpm")
    return shots, V.cut_grid(shots, t.music)


_FIX = "(SELECT e.variant_id, e.i, e.beats, CASE WHEN m.bpm IS NULL AND e.line IS NULL THEN coalesce(e.dur, 1.5::DOUBLE) ELSE e.dur END AS dur, e.line, e.line_s, e.start_s, e.hero, e.splittable FROM edit_shots e JOIN music m ON m.variant_id = e.variant_id)"
_G2 = _rec(["edit_shots", "music"], "").replace("FROM g JOIN edit_shots s", f"FROM g JOIN {_FIX} s")


@query("WN-20", [], None)
def _(t):
    return r6(_grid(t)[1].select("variant_id", "i", "t0", "t1", "voice_at"), "t0", "t1", "voice_at")


_PIECES = f""", gr AS (SELECT g.variant_id, g.i, round_even(g.t0, 4) AS t0, round_even(g.t1, 4) AS t1, round_even(round_even(g.t1, 4) - round_even(g.t0, 4), 4) AS dur, s.line, s.start_s, s.hero, s.splittable, m.bpm, m.beat0 FROM g JOIN {_FIX} s ON s.variant_id = g.variant_id AND s.i = g.i JOIN music m ON m.variant_id = g.variant_id),
   kk AS (SELECT *, CASE WHEN dur > 2.6::DOUBLE * 1.15::DOUBLE AND splittable AND NOT hero THEN CAST(ceil(dur / 2.6::DOUBLE) AS INT) ELSE 1 END AS k FROM gr),
   bb AS (SELECT *, list_transform(range(0, k + 1), lambda j: CASE WHEN j = 0 THEN t0 WHEN j = k THEN t1 WHEN bpm > 0 THEN beat0 + round_even((t0 + dur * j / k - beat0) / (30.0::DOUBLE / bpm), 0) * (30.0::DOUBLE / bpm) ELSE t0 + dur * j / k END) AS b FROM kk),
   cc AS (SELECT *, CASE WHEN bpm > 0 AND k > 1 AND list_bool_or(list_transform(range(1, k + 1), lambda j: b[j + 1] - b[j] < 0.5)) THEN [t0, t1] ELSE b END AS bd FROM bb), pp AS (SELECT *, unnest(range(0, len(bd) - 1)) AS piece FROM cc)"""
_SPLIT = _PIECES + """   SELECT variant_id, CAST(row_number() OVER (PARTITION BY variant_id ORDER BY i, piece) - 1 AS INT) AS new_i, i AS old_i, CAST(piece AS INT) AS piece, round(round_even(bd[piece + 1], 4), 6) AS p0, round(round_even(bd[piece + 2], 4), 6) AS p1, CASE WHEN piece % 2 = 1 THEN 1.22::DOUBLE ELSE 1.0::DOUBLE END AS zoom, CASE WHEN piece = 0 THEN line END AS line FROM pp"""


@query("WN-21", [], None)
def _(t):
    shots, g = _grid(t)
    g = g.join(shots.select("variant_id", "i", "start_s", "hero", "splittable"), ["variant_id", "i"])
    return r6(V.split_long(g, t.music).select("variant_id", "new_i", "old_i", "piece", "p0", "p1", "zoom", "line"), "p0", "p1")


@query("WN-21-captions", [], None)
def _(t):
    shots, g = _grid(t)
    pieces = V.split_long(g.join(shots.select("variant_id", "i", "start_s", "hero", "splittable"), ["variant_id", "i"]), t.music)
    # one caption a shot; some point at shots that are not there and stay as they are
    caps = t.edit_shots.select("variant_id", F.col("i").alias("caption"), F.when(F.col("i") % 4 == 3, F.col("i") + 1000).otherwise(F.col("i")).alias("seg"))
    return V.remap_captions(caps, pieces).select("variant_id", F.col("caption").cast("long").alias("caption"), F.col("seg").cast("long").alias("seg"))


def _register_recursive():
    from framelake.registry import ORACLES
    at = "CASE WHEN s.line IS NOT NULL THEN g.t0 + CASE WHEN g.i = 0 THEN 0.0::DOUBLE ELSE 0.14::DOUBLE END END"
    ORACLES["WN-20"] = _G2 + f" SELECT g.variant_id, g.i, round(round_even(g.t0, 4), 6) AS t0, round(round_even(g.t1, 4), 6) AS t1, round({at}, 6) AS voice_at FROM g JOIN {_FIX} s ON s.variant_id = g.variant_id AND s.i = g.i"
    ORACLES["WN-21"] = _G2 + _SPLIT
    ORACLES["WN-21-captions"] = _G2 + _PIECES + """, ix AS (SELECT variant_id, i, piece, row_number() OVER (PARTITION BY variant_id ORDER BY i, piece) - 1 AS new_i FROM pp),
       cp AS (SELECT variant_id, i AS caption, CASE WHEN i % 4 = 3 THEN i + 1000 ELSE i END AS seg FROM edit_shots)
       SELECT cp.variant_id, CAST(caption AS BIGINT) AS caption, CAST(coalesce(new_i, seg) AS BIGINT) AS seg FROM cp LEFT JOIN ix ON ix.variant_id = cp.variant_id AND ix.i = cp.seg AND ix.piece = 0"""


_register_recursive()


@query("AG-21", ["shots", "totals"], """SELECT video_id, count(*) AS shots, round(avg(dur), 6) AS mean, median(dur) AS median, arg_min(dur, i) AS first, max(dur) AS longest, count(*) FILTER (t0 < total_s / 3) AS third1, count(*) FILTER (t0 >= total_s * 1 / 3 AND t0 < total_s * 2 / 3) AS third2,
   count(*) FILTER (t0 >= total_s * 2 / 3 AND t0 < total_s * 3 / 3) AS third3, round(stddev_pop(dur) / avg(dur), 6) AS cv FROM shots JOIN totals USING (video_id) GROUP BY 1""")
def _(t):
    return r6(V.pacing(t.shots, t.totals), "mean", "cv")


@query("AG-22", ["voice_lines", "totals"], """SELECT t.video_id, round_even(coalesce(s, 0), 1) AS seconds, round_even(coalesce(s, 0) / total_s, 2) AS share, starts_at FROM totals t LEFT JOIN (SELECT video_id, sum((t1 - t0)::DECIMAL(18, 6))::DOUBLE AS s, min(t0) AS starts_at FROM voice_lines GROUP BY 1) v USING (video_id)""")
def _(t):
    return V.speech_share(t.voice_lines, t.totals)


@query("JN-20", ["captions", "shots"], """SELECT c.video_id, c.i, min(s.t1) AS cut, round_even(any_value(c.t1) - min(s.t1), 3) AS holds_s FROM captions c JOIN (SELECT *, max(i) OVER (PARTITION BY video_id) AS last FROM shots) s ON s.video_id = c.video_id AND s.i < s.last
   AND s.t1 > c.t0 + 0.15::DOUBLE AND s.t1 < c.t1 - 0.15::DOUBLE WHERE c.i % 4 <> 1 GROUP BY 1, 2 HAVING any_value(c.t1) - min(s.t1) > 0.35""")
def _(t):
    return V.text_cut(with_anchor(t), t.shots)


def with_anchor(t):
    """Captions taken from the voice carry the second the voice says them, with a small drift."""
    a = F.when(F.col("i") % 4 == 1, F.col("t0") + (F.col("i") % 3) * 0.15)
    return t.captions.withColumn("audio_t0", a).withColumn("source", F.when(a.isNotNull(), "sync"))


def with_says(t):
    return t.shots.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn("says", F.expr("CASE WHEN l_suppkey % 8 = 0 THEN array(p_name, 'of the') WHEN l_suppkey % 4 = 0 THEN array(p_name) END"))


def said_words(t):
    return t.heard.selectExpr("video_id", "i * 100 + pos as n", "t0", "t1", "w as text")


_SAYS = """, tk AS (SELECT video_id, w, t0, t1, row_number() OVER (PARTITION BY video_id ORDER BY i, pos) AS p FROM heard), pr AS (SELECT s.*, 0 AS k, lower(p_name) AS ph FROM shots s JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 4 = 0 UNION ALL SELECT s.*, 1 AS k, 'of the' AS ph FROM shots s WHERE l_suppkey % 8 = 0),
   h AS (SELECT pr.video_id, pr.i, pr.k, arg_min(a.t0, a.p) AS v0, arg_min(b.t1, a.p) AS v1 FROM pr JOIN tk a ON a.video_id = pr.video_id JOIN tk b ON b.video_id = a.video_id AND b.p = a.p + 1 AND lower(a.w) || ' ' || lower(b.w) = pr.ph GROUP BY 1, 2, 3),
   vi AS (SELECT pr.video_id, pr.i, pr.k, CASE WHEN h.v0 IS NULL THEN 'never said' WHEN h.v1 < pr.t0 - 0.25 OR h.v0 > pr.t1 + 0.25 THEN 'off screen' ELSE 'ok' END AS status, h.v0 AS said_at FROM pr LEFT JOIN h USING (video_id, i, k)) """


@query("JN-21", ["shots", "heard"], _SAYS + "SELECT * FROM vi")
def _(t):
    return V.voice_image(with_says(t), said_words(t))


_SW = """, sw AS (SELECT *, start_s + 0.15::DOUBLE AS w0, least(total_s, greatest(start_s + 0.6::DOUBLE, least(coalesce(nx - 0.2::DOUBLE, 1e12), start_s + CASE WHEN coalesce(duration_s, 0) <> 0 THEN duration_s - 0.1::DOUBLE ELSE 2.5::DOUBLE END))) AS w1 FROM (
   SELECT t.*, total_s, lead(start_s) OVER (PARTITION BY t.video_id ORDER BY i) AS nx FROM timed_lines t JOIN totals USING (video_id)) a),
   rc AS (SELECT s.video_id, s.i, CASE WHEN any_value(n) = 0 THEN 1 ELSE count(*) FILTER (hit) / any_value(n) END AS recall FROM (SELECT w.video_id, w.i, n, tok IS NOT NULL AND EXISTS (SELECT 1 FROM heard h WHERE h.ok AND h.video_id = w.video_id AND lower(h.w) = tok AND h.t0 >= w0 - 0.8::DOUBLE AND h.t0 <= w1 + 1.2::DOUBLE) AS hit
      FROM (SELECT *, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS tok, len(a) AS n FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS a FROM sw) z) w) s GROUP BY 1, 2)"""


def heard_ok(t):
    return t.heard.filter("ok").select("video_id", F.col("w").alias("text"), "t0")


@query("JN-22", ["timed_lines", "totals", "heard"], _SW + "SELECT video_id, i, round(recall, 6) AS recall FROM rc")
def _(t):
    return r6(V.recall(V.speech_windows(t.timed_lines, t.totals), heard_ok(t)), "recall")


_LV = _SW + """, ga AS (SELECT video_id, c + 0.4::DOUBLE AS g0, w0 - 0.4::DOUBLE AS g1 FROM (SELECT *, coalesce(max(w1) OVER (PARTITION BY video_id ORDER BY w0, w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM sw) a WHERE w0 - c > 1
      UNION ALL SELECT video_id, greatest(0, e) + 0.4::DOUBLE, total_s - 0.4::DOUBLE FROM (SELECT video_id, total_s, max(w1) AS e FROM sw GROUP BY 1, 2) b WHERE total_s - e > 1),
   gb AS (SELECT ga.video_id, g0, g1, avg(db) AS bg FROM ga JOIN (SELECT video_id, max(w1) AS le FROM sw GROUP BY 1) l USING (video_id) JOIN level_samples s ON s.video_id = ga.video_id AND s.t >= g0 AND s.t <= g1 WHERE g0 < le AND g1 - g0 > 0.05 GROUP BY 1, 2, 3),
   lw AS (SELECT sw.video_id, i, w0, w1, avg(db) AS level FROM sw JOIN level_samples s ON s.video_id = sw.video_id AND s.t >= w0 AND s.t <= w1 GROUP BY 1, 2, 3, 4),
   nb AS (SELECT video_id, i, avg(bg) AS background FROM (SELECT lw.video_id, lw.i, bg, row_number() OVER (PARTITION BY lw.video_id, lw.i ORDER BY least(abs(g0 - w1), abs(g1 - w0)), bg, g0) AS r FROM lw JOIN gb ON gb.video_id = lw.video_id AND g1 >= w0 - 10 AND g0 <= w1 + 10) q WHERE r <= 2 GROUP BY 1, 2),
   vl AS (SELECT lw.*, background, CASE WHEN level < -45 THEN 'silent' WHEN level - background < 4 THEN 'under the background' END AS weak FROM lw LEFT JOIN nb USING (video_id, i))"""


def levels(t):
    return V.weak_lines(V.voice_levels(t.timed_lines, t.level_samples, t.totals))


@query("JN-23", ["timed_lines", "totals", "heard", "level_samples"], _LV + "SELECT video_id, i, round(level, 6) AS level, round(background, 6) AS background, weak FROM vl")
def _(t):
    return r6(levels(t).select("video_id", "i", "level", "background", "weak"), "level", "background")


@query("JN-24", ["timed_lines", "captions"], """SELECT l.video_id, l.i, l.start_s, (arg_min(struct_pack(c := c.i), struct_pack(t0 := c.t0, i := c.i))).c AS cap, min(c.t0) AS cap_t0 FROM timed_lines l JOIN captions c ON c.video_id = l.video_id AND (lower(l.text) = lower(c.text) OR starts_with(lower(l.text), lower(c.text) || ' ')) GROUP BY 1, 2, 3""")
def _(t):
    return V.line_openers(t.timed_lines, t.captions)


@query("JN-27", ["shots", "voice_lines"], """SELECT s.video_id, s.i, round(coalesce(sum(CASE WHEN v.t0 IS NOT NULL THEN greatest(0, least(s.t1, v.t1) - greatest(s.t0, v.t0)) END), 0), 6) AS talk_s FROM shots s LEFT JOIN voice_lines v ON v.video_id = s.video_id AND v.t0 <= s.t1 AND s.t0 <= v.t1 GROUP BY 1, 2""")
def _(t):
    return r6(V.talk_in_shot(t.shots, t.voice_lines).select("video_id", "i", "talk_s"), "talk_s")


_REN = """, ev AS (SELECT video_id, t, 0 AS z FROM (SELECT video_id, round_even(t0, 2) AS t FROM shots UNION SELECT video_id, round_even(t0, 2) FROM captions UNION SELECT video_id, round_even(t0, 2) FROM voice_lines) a JOIN totals USING (video_id) WHERE t < total_s - 1 UNION ALL SELECT video_id, greatest(0, total_s - 1), 1 FROM totals),
   gp AS (SELECT *, lead(t) OVER (PARTITION BY video_id ORDER BY t, z) AS nx FROM ev),
   st AS (SELECT *, nx - t AS stale FROM gp WHERE nx > t AND NOT EXISTS (SELECT 1 FROM shots h WHERE h.hero AND h.video_id = gp.video_id AND h.t0 <= gp.t + 0.01 AND h.t1 >= gp.nx - 0.01)),
   rn AS (SELECT t.video_id, coalesce(s.stale, 0) AS stale_s, coalesce(s.t, 0) AS at_s FROM totals t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY stale DESC, t) AS r FROM st) s ON s.video_id = t.video_id AND s.r = 1)"""


@query("WN-16", ["shots", "captions", "voice_lines", "totals"], _REN + "SELECT video_id, round(stale_s, 6) AS stale_s FROM rn")
def _(t):
    return r6(V.renewal(t.shots, t.captions, t.voice_lines, t.totals).select("video_id", "stale_s"), "stale_s")


_FADE = """, fm AS (SELECT video_id, count(*) AS n, list_sort(list(y) FILTER (y IS NOT NULL))[count(y) // 2 + 1] AS typical FROM frame_stats GROUP BY 1 HAVING count(*) >= 12),
   fb AS (SELECT f.video_id, f.t, f.y, typical, CASE WHEN y IS NULL OR y < lag(y) OVER w - 1 THEN 1 ELSE 0 END AS bad, CASE WHEN y >= typical * 0.85::DOUBLE THEN 1 ELSE 0 END AS top FROM frame_stats f JOIN fm USING (video_id) WINDOW w AS (PARTITION BY f.video_id ORDER BY f.t DESC)),
   fr AS (SELECT video_id, any_value(typical) AS typical, min(t) AS from_s, arg_max(y, t) AS last_y FROM (SELECT *, max(bad) OVER (PARTITION BY video_id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS b, coalesce(max(top) OVER (PARTITION BY video_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM fb) x WHERE b = 0 AND p = 0 GROUP BY 1),
   fd AS (SELECT t.video_id, total_s, CASE WHEN last_y < greatest(2, typical * 0.5::DOUBLE) AND total_s - from_s < least(3, total_s / 3) THEN round_even(total_s - from_s, 3) ELSE 0 END AS fade_s FROM totals t JOIN (SELECT video_id FROM fm) q USING (video_id) LEFT JOIN fr USING (video_id)),
   fe AS (SELECT *, CASE WHEN fade_s > 0.05 THEN total_s - fade_s - 0.1::DOUBLE ELSE total_s END AS e FROM fd),
   em AS (SELECT fe.video_id, any_value(fade_s) AS fade_s, list_sort(list(d) FILTER (t > 0.5 AND t < e - 0.5::DOUBLE - 0.1::DOUBLE)) AS body, avg(d) FILTER (t >= e - 0.5::DOUBLE AND t < e) AS tail FROM fe JOIN frame_stats f ON f.video_id = fe.video_id GROUP BY 1),
   ep AS (SELECT video_id, fade_s, CASE WHEN body[len(body) // 2 + 1] >= 0.05 THEN tail / body[len(body) // 2 + 1] END AS motion FROM em)"""


def end_profile(t):
    fades = V.fade(t.frame_stats, t.totals)
    return V.end_motion(t.frame_stats, fades, t.totals)


@query("WN-18", ["frame_stats", "totals"], _FADE + "SELECT video_id, fade_s FROM fd")
def _(t):
    return V.fade(t.frame_stats, t.totals).select("video_id", "fade_s")


@query("WN-19", ["frame_stats", "totals"], _FADE + "SELECT video_id, fade_s, round(motion, 6) AS motion FROM ep")
def _(t):
    return r6(end_profile(t), "motion")
