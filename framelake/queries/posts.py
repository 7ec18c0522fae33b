"""Post statistics, preferences, rules, facts."""
import re

from pyspark.sql import functions as F

from framelake.operators import posts as P, rules as R
from framelake.registry import query

_BAND = "CASE WHEN duration_s < 0 THEN NULL WHEN duration_s < 12 THEN 'under 12s' WHEN duration_s < 20 THEN '12-20s' WHEN duration_s < 30 THEN '20-30s' WHEN duration_s < 45 THEN '30-45s' WHEN duration_s < 60 THEN '45-60s' WHEN duration_s < 1e9 THEN 'over 60s' END"
_CURVE = """CASE WHEN retention_text NOT LIKE '%oops%' THEN list_sort(list_transform(string_split(retention_text, ','), lambda x: {'t': CAST(regexp_extract(x, '([0-9.]+):', 1) AS DOUBLE), 'p': CAST(regexp_extract(x, ':([0-9.]+)', 1) AS DOUBLE)})) END"""
# three known points 0, 2, 5.5 in the bound curves: second 3 lies between the last two
_KEPT = "curve[2].p + (curve[3].p - curve[2].p) * (3.0::DOUBLE - curve[2].t) / (curve[3].t - curve[2].t)"


@query("PRJ-07", ["posts"], f"""SELECT id, band, curve_ok, len(curve) ::INT AS points, {_KEPT} AS kept3, saves / v AS saves_rate, comments / v AS comments_rate FROM (SELECT *, {_BAND} AS band, {_CURVE} AS curve,
  CASE WHEN retention_text IS NOT NULL THEN retention_text NOT LIKE '%oops%' END AS curve_ok, CASE WHEN views > 0 THEN views::DOUBLE END AS v FROM posts) s""")
def _(t):
    return P.post_features(t.posts).select("id", "band", "curve_ok", F.when(F.col("curve").isNotNull(), F.size("curve")).alias("points"), P.kept_at(F.col("curve"), 3.0).alias("kept3"), "saves_rate", "comments_rate")


_RATES = "(SELECT *, v AS views_r, saves / v AS saves_rate, likes / v AS likes_rate, comments / v AS comments_rate FROM (SELECT *, CASE WHEN views > 0 THEN views::DOUBLE END AS v FROM posts) a)"
_BASE = f"(SELECT platform, median(v) AS bv, median(saves_rate) AS bs, median(likes_rate) AS bl, median(comments_rate) AS bc, median(watch_pct) AS bw FROM {_RATES} r GROUP BY 1)"


def _term(v, b, w):
    return f"CASE WHEN {v} IS NOT NULL AND {b} <> 0 THEN {w}::DOUBLE * greatest(0.2::DOUBLE, least(5.0::DOUBLE, {v} / {b})) ELSE 0 END", f"CASE WHEN {v} IS NOT NULL AND {b} <> 0 THEN {w}::DOUBLE ELSE 0 END"


_T = [_term("v", "bv", 1), _term("saves_rate", "bs", 2), _term("watch_pct", "bw", 2), _term("comments_rate", "bc", 1), _term("likes_rate", "bl", 0.5)]
_SCORED = f"(SELECT r.*, ({' + '.join(x[0] for x in _T)}) / nullif({' + '.join(x[1] for x in _T)}, 0) AS score FROM {_RATES} r LEFT JOIN {_BASE} b USING (platform))"


@query("AG-09", ["posts"], f"""SELECT platform, metric, round(base, 9) AS base FROM (UNPIVOT (SELECT platform, bv AS views, bs AS saves_rate, bl AS likes_rate, bc AS comments_rate, bw AS watch_pct FROM {_BASE} z) ON views, saves_rate, likes_rate, comments_rate, watch_pct INTO NAME metric VALUE base) u""")
def _(t):
    return P.baseline(t.posts).withColumn("base", F.round("base", 9))


@query("AG-10", ["posts"], f"SELECT id, platform, round(score, 6) AS score FROM {_SCORED} s")
def _(t):
    return P.score_posts(t.posts).select("id", "platform", F.round("score", 6).alias("score"))


@query("AG-11", ["posts"], f"""SELECT platform, axis, name, n, round_even(raw, 2) AS score, round_even(greatest(0.7::DOUBLE, least(1.35::DOUBLE, 1.0::DOUBLE + (raw - 1.0::DOUBLE) * CASE WHEN n < 2 THEN 0.35::DOUBLE WHEN n < 4 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)), 2) AS weight,
   CASE WHEN n < 2 THEN 'anecdote' WHEN n < 4 THEN 'low' ELSE 'usable' END AS confidence FROM (SELECT platform, axis, name, count(*) AS n, median(score) AS raw FROM (
   UNPIVOT (SELECT platform, score, format, hook, close, voice, {_BAND} AS length FROM {_SCORED} s WHERE score IS NOT NULL) ON format, hook, close, voice, length INTO NAME axis VALUE name) u GROUP BY 1, 2, 3) g""")
def _(t):
    return P.group_weights(P.score_posts(t.posts))


@query("AG-11-changes", ["posts"], f"""SELECT f, 'formats' AS section, CASE WHEN weight >= 1.15::DOUBLE THEN 'worked' ELSE 'failed' END AS leaf, name AS value FROM (
   SELECT f, name, round_even(greatest(0.7::DOUBLE, least(1.35::DOUBLE, 1.0::DOUBLE + (raw - 1.0::DOUBLE) * CASE WHEN n < 4 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)), 2) AS weight FROM (
   SELECT id // 40 AS f, format AS name, count(*) AS n, median(score) AS raw FROM {_SCORED} s WHERE score IS NOT NULL AND format <> '' GROUP BY 1, 2) g WHERE n >= 2) w WHERE weight >= 1.15::DOUBLE OR weight <= 0.85::DOUBLE""")
def _(t):
    scored = P.score_posts(t.posts).withColumn("f", F.floor(F.col("id") / 40))
    return P.weights_to_changes(P.group_weights(scored, ("f",), ("format",)), ("f",))


@query("AG-12", ["posts"], f"""SELECT f, b.band FROM (SELECT DISTINCT id // 40 AS f FROM {_SCORED} s WHERE score IS NOT NULL AND ({_BAND}) IS NOT NULL) p, (VALUES ('under 12s'), ('12-20s'), ('20-30s'), ('30-45s'), ('45-60s'), ('over 60s')) b(band)
   WHERE NOT EXISTS (SELECT 1 FROM {_SCORED} s WHERE s.id // 40 = p.f AND score IS NOT NULL AND ({_BAND}) = b.band)""")
def _(t):
    return P.untried(P.score_posts(t.posts).withColumn("f", F.floor(F.col("id") / 40)), ("f",))


@query("AG-15", ["scores"], """SELECT post_id, CAST(round_even(p / 10.0::DOUBLE, 0) AS BIGINT) AS total, low_key, round_even(p / 10.0::DOUBLE, 0) < 65 OR low_key > 0 AS blocks FROM (
   SELECT post_id, CAST(sum(score * w) AS BIGINT) AS p, count(*) FILTER (criterion IN ('A2', 'A3', 'C1') AND score < 5) AS low_key FROM scores JOIN (VALUES ('A1',8),('A2',9),('A3',8),('B1',6),('B2',7),('B3',7),('C1',9),('C2',8),('C3',8),('D1',5),('D2',5),('D3',5),('E1',5),('E2',5),('F1',3),('F2',2)) x(c, w) ON c = criterion GROUP BY 1) s""")
def _(t):
    return P.rubric_total(t.scores)


_OUT = f""", w(c, w) AS (VALUES ('A1',8),('A2',9),('A3',8),('B1',6),('B2',7),('B3',7),('C1',9),('C2',8),('C3',8),('D1',5),('D2',5),('D3',5),('E1',5),('E2',5),('F1',3),('F2',2)),
   o AS (SELECT * FROM (SELECT id, platform, curve, coalesce(watch_pct, CASE WHEN avg_watch_s <> 0 AND duration_s <> 0 THEN 100.0::DOUBLE * avg_watch_s / duration_s END, {_KEPT}) AS y FROM (SELECT *, {_CURVE} AS curve FROM posts WHERE id IN (SELECT post_id FROM scores)) p) q WHERE y IS NOT NULL)"""


@query("AG-13", ["posts", "scores"], _OUT + """, x AS (SELECT o.platform, o.id, o.y, w.c AS criterion, coalesce(s.score, 0)::DOUBLE AS x FROM o CROSS JOIN w LEFT JOIN scores s ON s.post_id = o.id AND s.criterion = w.c),
   x2 AS (SELECT * FROM x UNION ALL SELECT platform, id, y, 'total', round_even(sum(x * w.w) / 10.0::DOUBLE, 0) FROM x JOIN w ON w.c = x.criterion GROUP BY 1, 2, 3),
   r AS (SELECT platform, criterion, rank() OVER (PARTITION BY platform, criterion ORDER BY x) + (count(*) OVER (PARTITION BY platform, criterion, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY platform, criterion ORDER BY y) + (count(*) OVER (PARTITION BY platform, criterion, y) - 1) / 2.0 AS ry FROM x2)
   SELECT platform, criterion, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END, 6) AS spearman FROM r GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    return P.calibrate(t.posts, t.scores).withColumn("spearman", F.round("spearman", 6))


@query("AG-14", ["posts", "scores"], _OUT + f"SELECT platform, round(median(100 - CASE WHEN coalesce({_KEPT}, 0) = 0 THEN 100 ELSE {_KEPT} END), 6) AS lost3 FROM o WHERE curve IS NOT NULL GROUP BY 1")
def _(t):
    return P.lost_in_3s(t.posts, t.scores).withColumn("lost3", F.round("lost3", 6))


@query("TK-03", ["posts"], "SELECT platform, id, published, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY published DESC, id) AS rank FROM posts) s WHERE rank <= 10")
def _(t):
    return P.list_posts(t.posts).select("platform", "id", "published", "rank")


@query("SNK-02", ["media"], """SELECT m.library_id, printf('h-%03d', row_number() OVER (PARTITION BY m.library_id ORDER BY date, m.id) + coalesce(top, 0)) AS id, m.name FROM media m LEFT JOIN
   (SELECT library_id, max(id) FILTER (k < 10) AS top FROM media GROUP BY 1) s ON s.library_id = m.library_id""")
def _(t):
    store = t.media.selectExpr("library_id", "concat(if(k < 10, 'h-', 'other-'), lpad(id, greatest(3, length(id)), '0')) as id")
    from framelake.plans.ordered import block_of
    return P.append_with_ids(store, t.media.select("library_id", "date", F.col("id").alias("item"), "name"), "h", ["library_id"], block_of("date", 3600), ["date", "item"]).select("library_id", "id", "name")


@query("SO-03", ["pref_lists", "pref_changes"], """, ch AS (SELECT owner, section, lower(value) AS v, arg_max(leaf, seq) AS leaf, arg_max(value, seq) AS value FROM pref_changes GROUP BY 1, 2, 3)
   SELECT l.owner, l.section, l.leaf, l.value FROM pref_lists l LEFT JOIN ch ON ch.owner = l.owner AND ch.section = l.section AND ch.v = lower(l.value) WHERE ch.leaf IS NULL OR ch.leaf = l.leaf
   UNION ALL SELECT ch.owner, ch.section, ch.leaf, ch.value FROM ch WHERE NOT EXISTS (SELECT 1 FROM pref_lists l WHERE l.owner = ch.owner AND l.section = ch.section AND lower(l.value) = ch.v AND l.leaf = ch.leaf)""")
def _(t):
    return P.pref_add(t.pref_lists, t.pref_changes)


@query("SO-04", ["rules", "new_rules"], """, n AS (SELECT owner, lower(text) AS t, count(*) AS n, arg_max(kind, seq) AS kind, arg_min(text, seq) AS text, min(seq) AS f FROM new_rules GROUP BY 1, 2)
   SELECT r.owner, r.id, r.text, coalesce(n.kind, r.kind) AS kind, CAST(r.hits + coalesce(n.n, 0) AS INT) AS hits FROM rules r LEFT JOIN n ON n.owner = r.owner AND n.t = lower(r.text)
   UNION ALL SELECT n.owner, printf('r-%03d', row_number() OVER (PARTITION BY n.owner ORDER BY f) + coalesce((SELECT max(CAST(substr(id, 3) AS BIGINT)) FROM rules r WHERE r.owner = n.owner), 0)), text, kind, CAST(n - 1 AS INT)
   FROM n WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.owner = n.owner AND lower(r.text) = n.t)""")
def _(t):
    return P.upsert_rules(t.rules, t.new_rules)


# ---- text rules ------------------------------------------------------------------------------
_W, _B0, _B1 = r"[\pL\pN_]", r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
_GUARD = [(r"(/Users/|/home/|[A-Za-z]:\\\\Users\\\\)[^\s/\\]+", "a home folder path"), (rf"((~|\.{{1,2}})/|(^|[^\pL\pN_])/)[\pL\pN_.\-]+/[\pL\pN_.\-]+", "a file path"),
          (rf"[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.]{{2,}}", "an email address"), (rf"{_B0}[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}{_B1}", "a library UUID"),
          (rf"(?i){_B0}(IMG|DSC|DCIM|PXL|VID|MVIMG|GOPR|GX\d\d|DJI|IMG_E)[_-]?\d{{3,}}{_B1}", "a camera file name"), (rf"(?i)\.(jpe?g|heic|heif|png|tiff?|dng|mov|mp4|m4v|insv|insp|360|webp|avif){_B1}", "a file name"),
          (r"\d[\d ().-]{8,}\d", "a phone number"), (rf"(?i){_B0}(pass(word|wd)|api[_ -]?key|secret|token|bearer|cvv|iban){_B1}", "a credential"), (rf"{_B0}\d{{13,19}}{_B1}", "a long number that could be a card")]


@query("PRJ-10", ["lines"], "SELECT doc_id, n, CASE WHEN c = '' THEN 'empty' WHEN length(c) > 5000 THEN 'too long' " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{w}'" for p, w in _GUARD)
       + " END AS refused FROM (SELECT doc_id, n, trim(regexp_replace(text, '[\\s\\x0b\\x85\\pZ]+', ' ', 'g')) AS c FROM (SELECT doc_id, n, text FROM lines UNION ALL SELECT -conv_id - 1, turn::INT, text FROM conversations) u) s")
def _(t):
    both = t.lines.select("doc_id", "n", "text").unionByName(t.conversations.selectExpr("-conv_id - 1 as doc_id", "cast(turn as int) as n", "text"))
    return R.guard(both, 5000).select("doc_id", "n", "refused")


_FACT = rf"(?i){_B0}(travell?ed|flew|went|arrived|met|was with|split up|stayed|visited|trip|viaj[óoéea]{_W}*|fu[ie]|lleg[óoué]{_W}*|regres[óoé]{_W}*|se separ{_W}*|conoc[íi]{_W}*|\d{{4}}-\d{{2}}-\d{{2}}|until|hasta que|from there|desde ah[íi]){_B1}"


@query("PRJ-11", ["lines"], f"SELECT doc_id, n, regexp_matches(text, '{_FACT}') AS factlike FROM lines")
def _(t):
    return R.looks_like_fact(t.lines).select("doc_id", "n", "factlike")


_PL = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", R.PLATE)
PRIVATE_KIND = rf"""CASE WHEN regexp_matches(text, '{_PL}') AND length(regexp_replace(text, '[\s·.-]', '', 'g')) >= 4 THEN 'plate'
   WHEN regexp_matches(text, '{R.PHONE}') AND length(regexp_replace(text, '\D', '', 'g')) >= 8 THEN 'phone' WHEN regexp_matches(text, '[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.]+') THEN 'email' END"""


@query("PRJ-12", ["lines"], f"""SELECT id, n, {PRIVATE_KIND} AS kind
   FROM (SELECT doc_id AS id, n, text FROM lines UNION ALL SELECT p_partkey, -1, p_name FROM part UNION ALL SELECT p_partkey, -2, upper(substr(p_name, 1, 2)) || ' ' || p_partkey % 10000 FROM part) u""")
def _(t):
    plates = t.part.selectExpr("p_partkey as id", "-2 as n", "concat(upper(substr(p_name, 1, 2)), ' ', p_partkey % 10000) as text")
    texts = t.lines.selectExpr("doc_id as id", "n", "text").unionByName(t.part.selectExpr("p_partkey as id", "-1 as n", "p_name as text")).unionByName(plates)
    return texts.select("id", "n", R.private_kind("text").alias("kind"))


@query("JN-11", ["lines", "facts"], """SELECT DISTINCT l.doc_id, l.n, l.source AS project, f.fact FROM lines l JOIN facts f ON f.project = l.source
   WHERE regexp_matches(l.text, '(?i)' || f.forbid) AND NOT regexp_matches(l.text, '(?i)' || f.allow_if)""")
def _(t):
    return R.contradictions(t.lines.select("doc_id", "n", F.col("source").alias("project"), "text"), t.facts).select("doc_id", "n", "project", "fact")


@query("JN-12", ["moments", "place_facts"], """SELECT u.project_id, u.place, u.uses, coalesce(f.n, 0) AS facts FROM (SELECT project_id, place, count(*) AS uses FROM (
      SELECT project_id, place FROM moments UNION ALL SELECT project_id, location FROM moments UNION ALL SELECT project_id, trim(city) FROM moments) a WHERE place IS NOT NULL GROUP BY 1, 2) u
   LEFT JOIN (SELECT project_id, lower(place) AS p, count(*) AS n FROM place_facts GROUP BY 1, 2) f ON f.project_id = u.project_id AND f.p = lower(u.place)""")
def _(t):
    return R.place_coverage(t.moments, t.place_facts)


@query("FLT-05", ["place_facts"], "SELECT page_id, source, seen FROM place_facts WHERE regexp_matches(source, '^https?://') AND seen IS NOT NULL AND DATE '2026-01-01' - seen BETWEEN 0 AND 90")
def _(t):
    return R.fresh_trends(t.place_facts, "2026-01-01").select("page_id", "source", "seen")


@query("FLT-06", ["lineitem"], """SELECT l_orderkey, l_linenumber, bpm_a, bpm_b, abs(greatest(bpm_a, bpm_b) / least(bpm_a, bpm_b) - 1) <= 0.03 OR abs(greatest(bpm_a, bpm_b) / least(bpm_a, bpm_b) / 2 - 1) <= 0.03 AS reliable
   FROM (SELECT l_orderkey, l_linenumber, 60.0::DOUBLE + l_quantity AS bpm_a, (60.0::DOUBLE + l_quantity) * CASE l_linenumber % 4 WHEN 0 THEN 1 + l_tax WHEN 1 THEN 2 WHEN 2 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS bpm_b FROM lineitem) s""")
def _(t):
    d = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "60.0D + l_quantity as bpm_a", "(60.0D + l_quantity) * case l_linenumber % 4 when 0 then 1 + l_tax when 1 then 2 when 2 then 0.5D else 1.5D end as bpm_b")
    return R.bpm_reliable(d)


@query("FLT-07", ["place_facts"], "SELECT page_id, place, kind, source FROM place_facts WHERE regexp_matches(source, '^https?://') AND kind IN ('price', 'time', 'how', 'tip', 'mistake', 'number') AND length(text) <= 1500")
def _(t):
    return R.valid_place_facts(t.place_facts, 1500).select("page_id", "place", "kind", "source")


@query("SRC-04", [], """SELECT conv_id AS artifact, '[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '].text' AS "where", text FROM conversations""")
def _(t):
    docs = t.conversations.groupBy(F.col("conv_id").alias("artifact")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("body"))
    return R.artifact_texts(docs)
