"""Face, variant and streaming queries."""
from pyspark.sql import functions as F

from framelake.operators import library as L, people as Pe, posts as P
from framelake.registry import Tables, query
from framelake.streaming import jobs as J

_D = "list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])"


@query("FLT-04", ["detected_faces", "assets"], """, f AS (SELECT d.library_id, d.asset, round_even(100.0::DOUBLE * (size * greatest(width, height)) * (size * greatest(width, height)) / (width::DOUBLE * height), 2) AS area_pct FROM detected_faces d JOIN assets a ON a.library_id = d.library_id AND a.pk = d.asset)
   SELECT a.library_id, a.pk AS asset, count(f.asset) AS big_faces FROM assets a LEFT JOIN f ON f.library_id = a.library_id AND f.asset = a.pk AND f.area_pct >= 0.15 GROUP BY 1, 2""")
def _(t):
    faces = L.face_boxes(t.detected_faces, t.assets)
    items = t.assets.select("library_id", F.col("pk").alias("asset"))
    k = ["library_id", "asset"]
    some = Pe.big_faces(faces).groupBy(*k).agg(F.count("*").alias("big_faces"))
    return some.unionByName(Pe.no_face(items, faces, k).withColumn("big_faces", F.lit(0).cast("long")))


@query("JN-16", ["face_embeddings"], f"SELECT a.g, a.key AS a, b.key AS b, round({_D}, 6) AS sim FROM face_embeddings a JOIN face_embeddings b ON a.g = b.g AND a.key < b.key WHERE {_D} > 0.363")
def _(t):
    return Pe.face_pairs(t.face_embeddings).withColumn("sim", F.round("sim", 6))


@query("JN-16-low", ["face_embeddings"], f"SELECT a.g, a.key AS a, b.key AS b, round({_D}, 6) AS sim FROM face_embeddings a JOIN face_embeddings b ON a.g = b.g AND a.key < b.key WHERE {_D} > 0.2")
def _(t):
    return Pe.face_pairs(t.face_embeddings, 0.2).withColumn("sim", F.round("sim", 6))


# Average link with every pair that chose each other merged per round; rounds are numbered and the last one counts.
_LINK = f""", s AS (SELECT a.g, a.key AS a, b.key AS b, {_D} AS sim FROM face_embeddings a JOIN face_embeddings b ON a.g = b.g AND a.key <> b.key),
   r(g, key, cluster, round) AS (SELECT g, key, key, 0 FROM face_embeddings
   UNION ALL
   SELECT cur.g, cur.key, coalesce(m.keep, cur.cluster), cur.round + 1 FROM r cur LEFT JOIN (
      SELECT p.g, p.y AS gone, p.x AS keep FROM (
         SELECT g, x, y, row_number() OVER (PARTITION BY g, x ORDER BY sim DESC, least(x, y), greatest(x, y)) AS k FROM (
            SELECT s.g, p.cluster AS x, q.cluster AS y, avg(s.sim) AS sim FROM s JOIN r p ON p.g = s.g AND p.key = s.a JOIN r q ON q.g = s.g AND q.key = s.b
            WHERE p.cluster <> q.cluster GROUP BY 1, 2, 3 HAVING avg(s.sim) > 0.2) z) p JOIN (
         SELECT g, x, y, row_number() OVER (PARTITION BY g, x ORDER BY sim DESC, least(x, y), greatest(x, y)) AS k FROM (
            SELECT s.g, p.cluster AS x, q.cluster AS y, avg(s.sim) AS sim FROM s JOIN r p ON p.g = s.g AND p.key = s.a JOIN r q ON q.g = s.g AND q.key = s.b
            WHERE p.cluster <> q.cluster GROUP BY 1, 2, 3 HAVING avg(s.sim) > 0.2) z) q
         ON p.g = q.g AND p.x = q.y AND p.y = q.x AND p.k = 1 AND q.k = 1 AND p.x < p.y) m ON m.g = cur.g AND m.gone = cur.cluster
   WHERE EXISTS (SELECT 1 FROM s JOIN r p ON p.g = s.g AND p.key = s.a JOIN r q ON q.g = s.g AND q.key = s.b WHERE p.cluster <> q.cluster
                 GROUP BY s.g, p.cluster, q.cluster HAVING avg(s.sim) > 0.2)),
   grouped AS (SELECT g, key, cluster FROM r WHERE round = (SELECT max(round) FROM r)) """


@query("WN-32", ["face_embeddings"], _LINK + "SELECT g, key, cluster FROM grouped", recursive=True)
def _(t):
    return Pe.cluster_faces(t.face_embeddings, 0.2)


@query("AG-19", ["face_embeddings"], _LINK + """, j AS (SELECT * FROM face_embeddings JOIN grouped USING (g, key)),
   n AS (SELECT g, cluster, count(*) AS faces, count(DISTINCT item) AS items FROM j GROUP BY 1, 2),
   top AS (SELECT g, cluster, string_agg(key, ',' ORDER BY k) AS best FROM (
      SELECT g, cluster, key, row_number() OVER (PARTITION BY g, cluster ORDER BY area_pct DESC, score DESC, key) AS k FROM j) z WHERE k <= 6 GROUP BY 1, 2)
   SELECT n.g, n.cluster, faces, items, best, (SELECT count(*) FROM n o WHERE o.g = n.g AND o.faces < 3) AS loose FROM n JOIN top USING (g, cluster) WHERE faces >= 3""", recursive=True)
def _(t):
    e = t.face_embeddings
    return Pe.cluster_report(e, Pe.cluster_faces(e, 0.2)).withColumn("best", F.array_join("best", ","))


_MATCH = """, m AS (SELECT g, person, p, avg(x::DOUBLE) AS x FROM (SELECT g, person, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM face_refs) z GROUP BY 1, 2, 3), r AS (SELECT g, person, list(x ORDER BY p) AS v FROM m GROUP BY 1, 2),
   s AS (SELECT e.g, r.person, e.item, max(list_dot_product(e.vec::DOUBLE[], r.v) / sqrt(list_dot_product(r.v, r.v))) AS similarity FROM face_embeddings e JOIN r ON r.g = e.g GROUP BY 1, 2, 3),
   k AS (SELECT g, person, item, similarity, CASE WHEN similarity >= 0.363 THEN 'match' WHEN similarity >= 0.363::DOUBLE - 0.08::DOUBLE THEN 'borderline' END AS kind FROM s) """


@query("JN-17", ["face_embeddings", "face_refs"], _MATCH + "SELECT g, person, item, round(similarity, 6) AS similarity, kind FROM k WHERE kind IS NOT NULL")
def _(t):
    return Pe.match_faces(t.face_embeddings, t.face_refs).withColumn("similarity", F.round("similarity", 6))


@query("TK-06", ["face_embeddings", "face_refs"], _MATCH + "SELECT g, person, item, kind, CAST(row_number() OVER (PARTITION BY g, person, kind ORDER BY round(similarity, 9) DESC, item) AS INT) AS rank FROM k WHERE kind IS NOT NULL")
def _(t):
    m = Pe.match_faces(t.face_embeddings, t.face_refs).withColumn("similarity", F.round("similarity", 9))
    return Pe.match_lists(m).drop("similarity")


def _verdict_sql(hit, same_h, same_c, n):
    return f"""SELECT concept_id, a, b, round(shared_shots, 9) AS shared_shots, round(length_ratio, 9) AS length_ratio, array_to_string(CASE WHEN len(x) > 0 AND length_ratio <= 0.75 THEN list_append(x, 'length') ELSE x END, ',') AS differs_on, ok FROM (
   SELECT *, list_filter([CASE WHEN shared_shots < 0.6 THEN 'shots' END, CASE WHEN NOT ({same_h}) THEN 'hook' END, CASE WHEN NOT ({same_c}) THEN 'close' END, CASE WHEN va <> vb THEN 'voice' END], lambda z: z IS NOT NULL) AS x, shared_shots < 0.6 AS ok FROM (
   SELECT p.concept_id, p.variant_id AS a, q.variant_id AS b, p.h AS ha, q.h AS hb, p.c AS ca, q.c AS cb, p.voiced AS va, q.voiced AS vb, coalesce(h.n, 0) / greatest(1, least(p.n, q.n)) AS shared_shots, least(p.len, q.len) / greatest(p.len, q.len) AS length_ratio
   FROM v p JOIN v q ON q.concept_id = p.concept_id AND p.variant_id < q.variant_id LEFT JOIN h ON h.a = p.variant_id AND h.b = q.variant_id) y) w"""


@query("JN-18", ["spec_shots"], """, s AS (SELECT *, round_even(start_s, 1) AS st FROM spec_shots), v AS (SELECT concept_id, variant_id, count(*) AS n, sum(dur::DECIMAL(28,6))::DOUBLE AS len, bool_or(narrated) AS voiced, arg_min([src, st], i) AS h, arg_max([src, st], i) AS c FROM s GROUP BY 1, 2),
   h AS (SELECT x.variant_id AS a, y.variant_id AS b, count(DISTINCT x.i) AS n FROM s x JOIN s y ON y.concept_id = x.concept_id AND y.variant_id > x.variant_id AND y.src = x.src AND abs(x.st - y.st) < 1 GROUP BY 1, 2) """
       + _verdict_sql("", "ha[1] = hb[1] AND abs(ha[2] - hb[2]) < 1", "ca[1] = cb[1] AND abs(ca[2] - cb[2]) < 1", ""))
def _(t):
    d = Pe.compare_specs(t.spec_shots)
    return d.withColumn("differs_on", F.array_join("differs_on", ",")).withColumn("shared_shots", F.round("shared_shots", 9)).withColumn("length_ratio", F.round("length_ratio", 9))


_AL = "(list_sum(list_transform(list_zip({x}, {y}), lambda z: abs(z[1] - z[2]))) / 32.0::DOUBLE < 22)"


@query("JN-19", ["thumbs"], """, t AS (SELECT *, list_avg(px) < 45 OR list_stddev_pop(px) < 12 AS flat FROM thumbs), u AS (SELECT * FROM (SELECT *, bool_and(flat) OVER (PARTITION BY concept_id, variant_id) AS allf FROM t) z WHERE NOT flat OR allf),
   v AS (SELECT t.concept_id, t.variant_id, any_value(k.n) AS n, sum(dur::DECIMAL(28,6))::DOUBLE AS len, bool_or(narrated) AS voiced, arg_min(px, i) AS h, arg_max(px, i) AS c FROM t JOIN (SELECT variant_id, count(*) AS n FROM u GROUP BY 1) k USING (variant_id) GROUP BY 1, 2),
   h AS (SELECT x.variant_id AS a, y.variant_id AS b, count(DISTINCT x.i) AS n FROM u x JOIN u y ON y.concept_id = x.concept_id AND y.variant_id > x.variant_id AND """ + _AL.format(x="x.px", y="y.px") + " GROUP BY 1, 2) "
       + _verdict_sql("", _AL.format(x="ha", y="hb"), _AL.format(x="ca", y="cb"), ""))
def _(t):
    d = Pe.compare_seen(t.thumbs)
    return d.withColumn("differs_on", F.array_join("differs_on", ",")).withColumn("shared_shots", F.round("shared_shots", 9)).withColumn("length_ratio", F.round("length_ratio", 9))


# ---- streams: the driver's files as file streams --------------------------------------------------
class Streams(Tables):
    """The same logical tables with one base table arriving as a stream."""

    def __init__(self, t, name):
        super().__init__(t.spark, t.dir)
        self._seen[name] = J.file_stream(t.spark, f"{t.dir}/{name}*.parquet")


_STATE = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END"


def updates(t):
    return Streams(t, "events").ev.selectExpr("user_id as unit", f"{_STATE} as state", "cast(ts as timestamp) as updated_at", "event_id as seq")


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("ST-01", ["ev"], f"""SELECT unit, CASE WHEN unit % 5 = 0 THEN 'done' WHEN state = 'done' THEN 'pending' ELSE state END AS state, updated_at, seq FROM (SELECT user_id AS unit, arg_max({_STATE}, (ts, event_id)) AS state, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS seq FROM ev GROUP BY 1) s""")
def _(t):
    artifacts = t.ev.selectExpr("user_id as unit").filter("unit % 5 = 0")
    return ntz(J.unit_state(updates(t), artifacts), "updated_at")


def _closed(key, gap, delay, extra):
    return f"""(SELECT * FROM (SELECT {key}, s, {extra}, max(ts) AS last_ts, min(ts) AS first_ts FROM (SELECT *, sum(f) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) > INTERVAL {gap} THEN 1 ELSE 0 END AS f FROM ev) a) b GROUP BY {key}, s) c WHERE last_ts + INTERVAL {gap} <= (SELECT max(ts) - INTERVAL {delay} FROM ev))"""


@query("ST-02", ["ev"], "SELECT user_id AS unit, state, last_ts AS last_update, updates FROM " + _closed("user_id", "2 MINUTE", "10 MINUTE", f"arg_max({_STATE}, (ts, event_id)) AS state, count(*) AS updates") + " z WHERE state <> 'done'")
def _(t):
    return ntz(J.drain(J.stalled(updates(t))), "last_update")


@query("ST-03", ["ev"], """SELECT user_id AS library_id, first_ts AS start, last_ts AS "end", n, photos, favorites FROM """ + _closed("user_id", "90 MINUTE", "1 HOUR", "count(*) AS n, count(*) FILTER (event_type IN ('click', 'view')) AS photos, count(*) FILTER (k % 7 = 0) AS favorites") + " z")
def _(t):
    m = Streams(t, "events").media.withColumn("date", F.col("date").cast("timestamp"))
    return ntz(J.drain(J.stream_sessions(m)), "start", "end")


_MET = "CASE l_linenumber % 3 WHEN 0 THEN 'views' WHEN 1 THEN 'saves' ELSE 'likes' END"


@query("ST-04", [], f"""SELECT id, max(value) FILTER (metric = 'views') AS views, max(value) FILTER (metric = 'saves') AS saves, max(value) FILTER (metric = 'likes') AS likes FROM (
   SELECT l_orderkey AS id, {_MET} AS metric, arg_max(l_quantity, (l_shipdate, l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2) s GROUP BY 1""")
def _(t):
    s = J.file_stream(t.spark, f"{t.dir}/lineitem*.parquet").selectExpr("l_orderkey as id", f"{_MET} as metric", "l_quantity as value", "l_shipdate as at", "l_extendedprice as seq")
    return J.stream_results(s)


@query("ST-05", ["ev"], "SELECT DISTINCT 'b' || user_id || '-' || k AS batch, k FROM ev")
def _(t):
    s = Streams(t, "events").ev.selectExpr("concat('b', user_id, '-', k) as batch", "k", "cast(ts as timestamp) as ts")
    return J.ingest_batches(s, time="ts").select("batch", "k")


@query("ST-06", ["lines", "facts"], """SELECT DISTINCT l.doc_id, l.n, l.source AS project, f.fact FROM lines l JOIN facts f ON f.project = l.source WHERE regexp_matches(l.text, '(?i)' || f.forbid) AND NOT regexp_matches(l.text, '(?i)' || f.allow_if)""")
def _(t):
    lines = Streams(t, "documents").lines.select("doc_id", "n", F.col("source").alias("project"), "text")
    return J.drain(J.stream_contradictions(lines, t.facts).select("doc_id", "n", "project", "fact")).distinct()


def _st07():
    from framelake.queries.posts import _SCORED
    return f"""SELECT platform, start, round(avg(score), 6) AS score, count(*) AS posts FROM (SELECT platform, score, time_bucket(INTERVAL 7 DAY, published, TIMESTAMP '1970-01-01') AS start FROM {_SCORED} s WHERE score IS NOT NULL) x
      WHERE start + INTERVAL 7 DAY <= (SELECT max(published) - INTERVAL 1 DAY FROM {_SCORED} s WHERE score IS NOT NULL) GROUP BY 1, 2"""


@query("ST-07", ["posts"], _st07())
def _(t):
    s = Streams(t, "orders").posts.withColumn("published", F.col("published").cast("timestamp"))
    return ntz(J.drain(J.stream_scores(s, P.baseline(t.posts))).withColumn("score", F.round("score", 6)), "start")
