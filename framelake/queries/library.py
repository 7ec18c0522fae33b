"""Capture-library queries."""
from pyspark.sql import functions as F

from framelake.operators import library as L
from framelake.registry import query
from framelake.sources import readers as R

AS_OF = "2026-01-01 00:00:00"
join = lambda col: F.array_join(col, ",")


def people_text(df, col="people"):
    return df.withColumn(col, F.array_join(col, ","))


@query("SRC-01", ["media"], """
  SELECT library_id, CASE WHEN ext IN ('.insv','.insp','.vr','.360') THEN '360' WHEN ext IN ('.mov','.mp4','.m4v','.avi','.mkv','.hevc') THEN 'video'
     WHEN ext IN ('.jpg','.jpeg','.png','.heic','.heif','.tif','.tiff','.dng','.webp','.avif') THEN 'photo' ELSE 'skipped' END AS kind,
     count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes
  FROM (SELECT library_id, bytes, lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1)) AS ext
        FROM (SELECT library_id, bytes, CASE WHEN k % 30 = 4 THEN '.' ELSE '' END || CASE WHEN k % 30 = 5 THEN name || '.txt' ELSE name END AS name FROM media) a
        WHERE name NOT LIKE '.%') s GROUP BY 1, 2""")
def _(t):
    listing = t.media.selectExpr("library_id", "bytes as length", """concat('/m/', library_id, '/', if(k % 30 = 4, '.', ''), if(k % 30 = 5, concat(name, '.txt'), name)) as path""")
    return R.classify_listing(listing, ["library_id"])


_SNAP = """
  SELECT a.library_id, a.uuid AS id, coalesce(x.original_name, a.filename) AS name,
    CASE WHEN a.filename IS NULL THEN CASE WHEN a.kind = 1 THEN 'video' ELSE 'photo' END WHEN a.filename LIKE '%.insv' THEN '360' WHEN a.filename LIKE '%.MOV' THEN 'video' ELSE 'photo' END AS type,
    make_timestamp(CAST(floor(a.created_s + 978307200) AS BIGINT) * 1000000 + coalesce(x.tz_offset_s, 0)::BIGINT * 1000000) AS date,
    CASE WHEN a.lat <= -180 OR (a.lat = 0 AND a.lon = 0) THEN NULL ELSE a.lat END AS lat,
    coalesce(f.n, 0) AS faces, coalesce(f.people, '') AS people, round_even(a.duration_s, 2) AS duration_s,
    CASE WHEN x.original_size <> 0 THEN x.original_size ELSE r.b END AS bytes, coalesce(r.l, FALSE) AS local
  FROM assets a LEFT JOIN asset_attrs x ON x.library_id = a.library_id AND x.asset = a.pk
    LEFT JOIN (SELECT d.library_id, d.asset, count(*) AS n, string_agg(DISTINCT p.full_name, ',' ORDER BY p.full_name) AS people FROM detected_faces d
       LEFT JOIN persons p ON p.library_id = d.library_id AND p.pk = d.person WHERE NOT d.in_trash GROUP BY 1, 2) f ON f.library_id = a.library_id AND f.asset = a.pk
    LEFT JOIN (SELECT library_id, asset, max(CASE WHEN availability = 1 THEN 1 ELSE 0 END) = 1 AS l, max(data_length) AS b FROM resources WHERE resource_type = 0 GROUP BY 1, 2) r
       ON r.library_id = a.library_id AND r.asset = a.pk
  WHERE NOT a.trashed AND NOT a.hidden"""


@query("SRC-02", ["assets", "asset_attrs", "detected_faces", "persons", "resources"], _SNAP)
def _(t):
    m = L.media_from_library(t.assets, t.asset_attrs, t.detected_faces, t.persons, t.resources)
    return people_text(m.select("library_id", "id", "name", "type", "date", "lat", "faces", "people", "duration_s", "bytes", "local"))


@query("PRJ-01", ["raw_times"], """
  SELECT library_id, id, coalesce(make_timestamp(us + coalesce(tz_offset_s, 0)::BIGINT * 1000000), p) AS date,
     coalesce(make_timestamp(us), CASE WHEN regexp_matches(o, '^[+-][0-9]{4}$') THEN p - to_seconds(CASE WHEN o LIKE '-%' THEN -1 ELSE 1 END * (CAST(o[2:3] AS INT) * 3600 + CAST(o[4:5] AS INT) * 60)) END) AS date_utc,
     text IS NOT NULL AND p IS NULL AS unreadable
  FROM (SELECT *, CAST(floor(created_s + 978307200) AS BIGINT) * 1000000 AS us, replace(offset_text, ':', '') AS o,
     try_strptime(replace(text, ' ', 'T'), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d']) + CASE WHEN length(text) = 10 AND text LIKE '2%' THEN INTERVAL 86399 SECOND ELSE INTERVAL 0 SECOND END AS p FROM raw_times) s""")
def _(t):
    return L.normalize_time(t.raw_times, end_of_day=True).select("library_id", "id", "date", "date_utc", "unreadable")


_NAME = """(SELECT *, coalesce(
     try_strptime(nullif(regexp_extract(name, '(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})[-_ T]?([0-9]{2})[-_.:]?([0-9]{2})[-_.:]?([0-5][0-9])', 0), ''), ['%Y%m%d_%H%M%S', '%Y-%m-%d %H.%M.%S']),
     try_strptime(regexp_extract(name, '(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})', 1) || regexp_extract(name, '(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})', 2) || regexp_extract(name, '(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})', 3), '%Y%m%d') + INTERVAL 12 HOUR) AS name_date FROM named_files)"""


@query("PRJ-02", ["named_files"], f"SELECT library_id, id, name, name_date FROM {_NAME} s")
def _(t):
    return L.dates_from_names(t.named_files).select("library_id", "id", "name", "name_date")


@query("PRJ-03", ["named_files"], f"""
  SELECT library_id, id, coalesce(m, name_date, mtime) AS date, CASE WHEN m IS NOT NULL THEN 'exif' WHEN name_date IS NOT NULL THEN 'file-name' ELSE 'mtime' END AS date_origin
  FROM (SELECT *, coalesce(meta_date, try_strptime(replace(tag_creationdate, '+02:00', ''), '%Y-%m-%d %H:%M:%S'), try_strptime(replace(tag_creation_time, 'Z', ''), '%Y-%m-%d %H:%M:%S'), try_strptime(tag_date, '%Y-%m-%d')) AS m FROM {_NAME} s) s2""")
def _(t):
    return L.resolve_dates(t.named_files).select("library_id", "id", "date", "date_origin")


@query("PRJ-04", ["raw_places"], """
  SELECT library_id, id, CASE WHEN known THEN lat WHEN a IS NOT NULL THEN round_even(a, 6) WHEN i <> '' THEN CAST(regexp_extract(trim(iso6709), i_re, 1) AS DOUBLE) END AS lat,
     CASE WHEN known THEN lon WHEN a IS NOT NULL THEN round_even(b, 6) WHEN i <> '' THEN CAST(regexp_extract(trim(iso6709), i_re, 2) AS DOUBLE) END AS lon
  FROM (SELECT *, lat IS NOT NULL AND NOT (lat <= -180 OR (lat = 0 AND lon = 0)) AS known, '^([+-][0-9]+\\.?[0-9]*)([+-][0-9]+\\.?[0-9]*)' AS i_re, regexp_extract(trim(iso6709), '^([+-][0-9]+\\.?[0-9]*)([+-][0-9]+\\.?[0-9]*)', 0) AS i,
     CASE WHEN lat_ref = 's' THEN -1 ELSE 1 END * (lat_d + lat_m / 60 + lat_s / 3600) AS a, CASE WHEN lon_ref = 'W' THEN -1 ELSE 1 END * (lon_d + lon_m / 60 + lon_s / 3600) AS b FROM raw_places) s""")
def _(t):
    return L.normalize_location(t.raw_places).select("library_id", "id", "lat", "lon")


@query("PRJ-05", ["named_files"], """
  SELECT library_id, id, CASE WHEN name LIKE '%.insv' THEN '360' WHEN regexp_matches(name, '(?i)\\.(mp4|mov)$') THEN 'video' WHEN regexp_matches(name, '(?i)\\.(jpg|heic)$') THEN 'photo' WHEN k % 2 = 1 THEN 'video' ELSE 'photo' END AS type,
     CASE WHEN regexp_matches(stem, '[A-Za-z]') THEN upper(regexp_extract(stem, '[A-Za-z]+', 0)) ELSE 'digits' || length(stem) END AS camera
  FROM (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM (SELECT library_id, id, k, CASE WHEN k % 11 = 0 THEN replace(replace(name, '.jpg', '.bin'), '.MOV', '') ELSE name END AS name FROM named_files) x) s""")
def _(t):
    d = t.named_files.selectExpr("library_id", "id", "cast(k % 2 as int) as kind", "if(k % 11 = 0, replace(replace(name, '.jpg', '.bin'), '.MOV', ''), name) as name")
    return L.classify_media(d).select("library_id", "id", "type", "camera")


@query("PRJ-06", ["detected_faces", "assets"], """
  SELECT d.library_id, d.asset, d.person, cx * width - size * greatest(width, height) AS x0, (1 - cy) * height - size * greatest(width, height) AS y0,
    cx * width + size * greatest(width, height) AS x1, (1 - cy) * height + size * greatest(width, height) AS y1,
    round_even(100.0::DOUBLE * (size * greatest(width, height)) * (size * greatest(width, height)) / (width::DOUBLE * height), 2) AS area_pct
  FROM detected_faces d JOIN assets a ON a.library_id = d.library_id AND a.pk = d.asset""")
def _(t):
    return L.face_boxes(t.detected_faces, t.assets).select("library_id", "asset", "person", "x0", "y0", "x1", "y1", "area_pct")


@query("FLT-01", ["assets"], "SELECT library_id, pk, uuid, created_s FROM assets WHERE NOT trashed AND NOT hidden AND favorite AND NOT screenshot AND created_s >= 726000000 AND created_s <= 728000000")
def _(t):
    return L.library_filter(t.assets, 726000000, 728000000, include_screenshots=False, favorites_only=True).select("library_id", "pk", "uuid", "created_s")


@query("JN-01", ["assets", "asset_attrs"], """SELECT a.library_id, a.pk, a.uuid, x.tz_name, x.original_name, x.original_size FROM assets a
  LEFT JOIN asset_attrs x ON x.library_id = a.library_id AND x.asset = a.pk""")
def _(t):
    return L.with_attributes(t.assets, t.asset_attrs).select("library_id", "pk", "uuid", "tz_name", "original_name", "original_size")


@query("JN-02", ["detected_faces", "persons"], """SELECT d.library_id, d.asset, count(*) AS faces, coalesce(string_agg(DISTINCT p.full_name, ',' ORDER BY p.full_name), '') AS people
  FROM detected_faces d LEFT JOIN persons p ON p.library_id = d.library_id AND p.pk = d.person WHERE NOT d.in_trash GROUP BY 1, 2""")
def _(t):
    return people_text(L.faces_per_asset(t.detected_faces, t.persons))


@query("JN-03", ["assets", "detected_faces", "persons"], """SELECT library_id, pk, uuid FROM assets a WHERE EXISTS (SELECT 1 FROM detected_faces d JOIN persons p ON p.library_id = d.library_id AND p.pk = d.person
  WHERE d.library_id = a.library_id AND d.asset = a.pk AND (p.full_name = 'P4' OR p.display_name = 'P4'))""")
def _(t):
    return L.of_person(t.assets, t.detected_faces, t.persons, "P4").select("library_id", "pk", "uuid")


@query("JN-04", ["assets", "resources"], """SELECT a.library_id, a.pk, coalesce(r.l, FALSE) AS local, r.b AS original_bytes FROM assets a LEFT JOIN
  (SELECT library_id, asset, bool_or(availability = 1) AS l, max(data_length) AS b FROM resources WHERE resource_type = 0 GROUP BY 1, 2) r ON r.library_id = a.library_id AND r.asset = a.pk""")
def _(t):
    return L.local_originals(t.assets, t.resources).select("library_id", "pk", "local", "original_bytes")


@query("SO-01", ["media"], """SELECT library_id, id, name, type, date, lat, bytes, source FROM media WHERE source = 'photos'
  UNION ALL SELECT library_id, id, name, type, date, NULL, bytes, source FROM media WHERE source = 'folder'""")
def _(t):
    cols = ["library_id", "id", "name", "type", "date", "bytes", "source"]
    photos = t.media.filter("source = 'photos'").select(*cols, "lat")
    return L.union_sources(photos, t.media.filter("source = 'folder'").select(*cols), FileNotFoundError("the folder /gone doesn't exist"))[0]


@query("AG-01", ["media"], """SELECT library_id, count(*) AS total, count(*) FILTER (type = 'photo') AS photos, count(*) FILTER (type = 'video') AS videos, count(*) FILTER (type = '360') AS material_360,
  count(*) FILTER (favorite) AS favorites, count(*) FILTER (screenshot) AS screenshots, count(lat) AS with_gps, round_even(100.0::DOUBLE * count(lat) / count(*), 1) AS gps_pct,
  count(*) FILTER (faces > 0) AS with_faces, round_even(100.0::DOUBLE * count(*) FILTER (faces > 0) / count(*), 1) AS faces_pct FROM media GROUP BY 1""")
def _(t):
    return L.inventory(t.media)


@query("AG-02", ["media"], "SELECT library_id, min(date) AS first, max(date) AS last, CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) AS BIGINT) + 1 AS days FROM media GROUP BY 1")
def _(t):
    return L.date_range(t.media)


@query("AG-03", ["media"], "SELECT library_id, place, count(*) AS n, min(date) AS first, max(date) AS last FROM media WHERE place IS NOT NULL GROUP BY 1, 2")
def _(t):
    return L.place_summary(t.media)


@query("AG-04", ["media_people"], "SELECT library_id, name, count(*) AS photos FROM media_people GROUP BY 1, 2")
def _(t):
    return L.people_counts(t.media_people)


@query("AG-04-named", ["detected_faces", "persons"], """SELECT p.library_id, p.pk AS person, coalesce(full_name, display_name) AS name, count(DISTINCT d.asset) AS photos
  FROM persons p JOIN detected_faces d ON d.library_id = p.library_id AND d.person = p.pk WHERE coalesce(full_name, display_name) IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT d.asset) >= 10""")
def _(t):
    return L.library_people(t.detected_faces, t.persons, 10)


@query("AG-05", ["media"], """SELECT *, round_even(estimated_bytes / 1073741824.0::DOUBLE, 2) AS estimated_gb, CASE WHEN without_size = 0 THEN 'exact' ELSE 'approximate' END AS accuracy FROM (
  SELECT library_id, count(*) FILTER (local) AS local_originals, count(*) FILTER (NOT local) AS missing, count(*) FILTER (NOT local AND coalesce(bytes, 0) = 0) AS without_size,
  CAST(sum(CASE WHEN local THEN 0 WHEN coalesce(bytes, 0) = 0 THEN 1048576 * CASE type WHEN 'photo' THEN 4 WHEN 'video' THEN 90 ELSE 400 END ELSE bytes END) AS BIGINT) AS estimated_bytes FROM media GROUP BY 1) s""")
def _(t):
    return L.download(t.media)


@query("AG-06", ["media"], "SELECT library_id, count(*) AS clips, round_even(sum(duration_s::DECIMAL(28,3))::DOUBLE, 1) AS total_s, round_even(sum(duration_s::DECIMAL(28,3))::DOUBLE / 60, 1) AS total_min FROM media WHERE type <> 'photo' GROUP BY 1")
def _(t):
    return L.video_totals(t.media)


def _sessions_sql(minutes):
    return f"""(SELECT *, sum(fresh) OVER (PARTITION BY library_id ORDER BY date, id) AS session FROM (
     SELECT *, CASE WHEN lag(date) OVER w IS NULL OR date - lag(date) OVER w > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END AS fresh FROM media WINDOW w AS (PARTITION BY library_id ORDER BY date, id)) a)"""


@query("WN-01", ["media"], f"SELECT library_id, id, date, CAST(session AS BIGINT) AS session FROM {_sessions_sql(90)} s")
def _(t):
    return L.sessions(t.media).select("library_id", "id", "date", "session")


@query("WN-01-12h", ["media"], f"SELECT library_id, id, date, CAST(session AS BIGINT) AS session FROM {_sessions_sql(720)} s")
def _(t):
    return L.sessions(t.media, 720).select("library_id", "id", "date", "session")


@query("AG-07", ["media"], f"""SELECT g.*, p.place FROM (SELECT library_id, CAST(session AS BIGINT) AS session, min(date) AS start, max(date) AS "end",
    round_even((epoch_us(max(date)) - epoch_us(min(date))) / 60e6, 1) AS duration_min, count(*) AS n, count(*) FILTER (type = 'photo') AS photos, count(*) FILTER (type <> 'photo') AS videos,
    count(*) FILTER (favorite) AS favorites, count(*) FILTER (faces > 0) AS with_faces FROM {_sessions_sql(720)} s GROUP BY 1, 2) g
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY library_id, session ORDER BY c DESC, d, i) AS r FROM (
     SELECT library_id, session, place, count(*) AS c, min(date) AS d, arg_min(id, (date, id)) AS i FROM {_sessions_sql(720)} s WHERE place IS NOT NULL GROUP BY 1, 2, 3) x) p
  ON p.library_id = g.library_id AND p.session = g.session AND p.r = 1""")
def _(t):
    return L.session_summary(t.media, 720)


@query("AG-08", ["place_rows"], """SELECT library_id, id, country, city, neighbourhood, CASE WHEN coalesce(city, neighbourhood) IS NULL THEN country ELSE coalesce(city, neighbourhood) || coalesce(', ' || country, '') END AS text
  FROM (SELECT library_id, id, max(name) FILTER (code = 1) AS country, max(name) FILTER (code = 4) AS city, max(name) FILTER (code = 6) AS neighbourhood FROM (
    SELECT *, row_number() OVER (PARTITION BY library_id, id, code ORDER BY area DESC, pos) AS r FROM place_rows WHERE name IS NOT NULL AND code <> 99) s WHERE r = 1 GROUP BY 1, 2) x""")
def _(t):
    return L.resolve_place(t.place_rows).select("library_id", "id", "country", "city", "neighbourhood", "text")


@query("AG-24", ["media"], """SELECT library_id, source, type, CAST(grouping(library_id, source, type) AS BIGINT) AS level, count(*) AS n, min(date) AS first, max(date) AS last, count(*) FILTER (NOT local) AS cloud_only,
  CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM media GROUP BY ROLLUP (library_id, source, type)""")
def _(t):
    return L.source_report(t.media)


_BAD = f"(year(date) < 2000 OR date > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY)"


@query("AG-28", ["media_faults"], f"""SELECT library_id, "case", count(*) AS n, string_agg(name, ',' ORDER BY id) FILTER (r <= 5) AS examples FROM (
   SELECT *, row_number() OVER (PARTITION BY library_id, "case" ORDER BY id) AS r FROM (
     SELECT library_id, id, name, 'no_date' AS "case" FROM media_faults WHERE date IS NULL OR date_origin IS NULL
     UNION ALL SELECT library_id, id, name, 'mtime_only' FROM media_faults WHERE date_origin = 'mtime'
     UNION ALL SELECT library_id, id, name, 'impossible_date' FROM media_faults WHERE {_BAD}) a) b GROUP BY 1, 2""")
def _(t):
    return people_text(L.simple_suspicions(t.media_faults, AS_OF), "examples")


@query("WN-02", ["media_faults"], f"""WITH rest AS (SELECT library_id, id, date FROM media_faults WHERE date IS NOT NULL AND NOT {_BAD}),
  cl AS (SELECT *, sum(f) OVER (PARTITION BY library_id ORDER BY date, id) AS cluster FROM (SELECT *, CASE WHEN lag(date) OVER w IS NULL OR floor((epoch_us(date) - epoch_us(lag(date) OVER w)) / 86400000000) > 30 THEN 1 ELSE 0 END AS f
     FROM rest WINDOW w AS (PARTITION BY library_id ORDER BY date, id)) a),
  rk AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY library_id) AS total, row_number() OVER (PARTITION BY library_id, cluster ORDER BY date) - 1 AS ci, count(*) OVER (PARTITION BY library_id, cluster) AS n FROM cl),
  m AS (SELECT library_id, date AS median, total FROM rk WHERE i = total // 2), c AS (SELECT library_id, cluster, n, date AS centre FROM rk WHERE ci = n // 2)
  SELECT library_id, CAST(cluster AS BIGINT) AS cluster, n, centre, median, -d AS shift_days FROM (SELECT *, CAST(floor((epoch_us(centre) - epoch_us(median)) / 86400000000) AS BIGINT) AS d FROM c JOIN m USING (library_id)) x WHERE total >= 4 AND abs(d) > 180 AND n <> total""".replace("WITH rest", ", rest", 1))
def _(t):
    return L.distant_batches(t.media_faults, AS_OF)


@query("WN-03", ["media_faults"], f""", m AS (SELECT library_id, id, date, upper(regexp_extract(name, '[A-Za-z]+', 0)) AS camera, date_trunc('day', date) AS day, hour(date) + minute(date) / 60.0::DOUBLE AS h FROM media_faults WHERE NOT {_BAD}),
  r AS (SELECT *, row_number() OVER (PARTITION BY library_id, camera ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY library_id, camera) AS n FROM m),
  g AS (SELECT library_id, camera, any_value(n) AS n, max(h) FILTER (i = n // 2) AS mid, min((date, id)) AS seen FROM r GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY n DESC, seen) AS pos FROM g),
  j AS (SELECT a.library_id, a.camera, b.camera AS ref_camera, a.n, a.pos, a.mid - b.mid AS d FROM o a JOIN o b ON b.library_id = a.library_id AND b.pos = 1 WHERE a.pos > 1 AND a.n >= 3
     AND EXISTS (SELECT 1 FROM m x JOIN m y ON x.library_id = y.library_id AND x.day = y.day WHERE x.library_id = a.library_id AND x.camera = a.camera AND y.camera = b.camera))
  SELECT library_id, camera, ref_camera, n, CAST(-round_even(d, 0) AS BIGINT) AS shift_hours FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY pos) AS f FROM j WHERE abs(d) >= 2 AND abs(d - round_even(d, 0)) <= 0.35) z WHERE f = 1""")
def _(t):
    return L.clock_offset(t.media_faults, AS_OF)


_ALIVE = """ , alive AS (SELECT * FROM corrections c WHERE NOT EXISTS (SELECT 1 FROM corrections a JOIN corrections b ON a.library_id = b.library_id AND a.id = b.id AND b.seq > a.seq WHERE a.library_id = c.library_id AND a.seq = c.seq)) """


@query("JN-09", ["media", "corrections"], _ALIVE + """
  SELECT m.library_id, m.id, coalesce(n, m.date) AS date, CASE WHEN n IS NOT NULL THEN m.date END AS original_date, CASE WHEN n IS NOT NULL THEN 'corrected' ELSE date_origin END AS date_origin
  FROM media m LEFT JOIN (SELECT c.library_id, c.id, CASE WHEN action = 'assign_date' THEN new_date ELSE x.date + to_microseconds(CAST(amount * CASE action WHEN 'offset_hours' THEN 3600000000 ELSE 86400000000 END AS BIGINT)) END AS n
     FROM alive c JOIN media x ON x.library_id = c.library_id AND x.id = c.id) p ON p.library_id = m.library_id AND p.id = m.id""")
def _(t):
    return L.apply_corrections(t.media, t.corrections).select("library_id", "id", "date", "original_date", "date_origin")


@query("TK-07", ["media_faults", "corrections"], f"""SELECT library_id, "case", count(*) AS n, count(*) FILTER (o) AS open, CAST(any_value(position) AS INT) AS position FROM (
   SELECT x.*, NOT EXISTS (SELECT 1 FROM corrections c WHERE c.library_id = x.library_id AND c.id = x.id) AS o FROM (
     SELECT library_id, id, 'no_date' AS "case", 1 AS position FROM media_faults WHERE date_origin IS NULL UNION ALL SELECT library_id, id, 'mtime_only', 2 FROM media_faults WHERE date_origin = 'mtime'
     UNION ALL SELECT library_id, id, 'impossible_date', 3 FROM media_faults WHERE {_BAD}) x) y GROUP BY 1, 2 HAVING count(*) FILTER (o) > 0""")
def _(t):
    bad = L._impossible(AS_OF, 2000)
    cases = t.media_faults.select("library_id", "id", F.explode(F.array_compact(F.array(
        F.when(F.col("date_origin").isNull(), F.lit("no_date")), F.when(F.col("date_origin") == "mtime", F.lit("mtime_only")), F.when(bad, F.lit("impossible_date"))))).alias("case"))
    return L.open_cases(cases, t.corrections)


@query("JN-14", ["media"], """SELECT c.library_id, c.id AS candidate, m.id, round(epoch_us(m.date) / 1e6 - epoch_us(c.date) / 1e6, 3) AS gap_s FROM media c JOIN media m ON m.library_id = c.library_id
  AND m.id <> c.id AND abs(epoch_us(m.date) - epoch_us(c.date)) <= 600000000 WHERE c.favorite""")
def _(t):
    return L.neighbours(t.media, t.media.filter("favorite"))


@query("JN-15", ["media"], """SELECT library_id, id, coalesce(place, near) AS place, place IS NULL AND near IS NOT NULL AS inferred FROM (
   SELECT m.*, CASE WHEN b IS NOT NULL AND (a IS NULL OR b <= a) THEN bp WHEN a IS NOT NULL THEN ap END AS near FROM (
     SELECT library_id, id, date, place, CASE WHEN u - lu <= 7200000000 THEN u - lu END AS b, lp AS bp, CASE WHEN nu - u <= 7200000000 THEN nu - u END AS a, np AS ap FROM (
       SELECT *, epoch_us(date) AS u, last_value(CASE WHEN place IS NOT NULL THEN epoch_us(date) END IGNORE NULLS) OVER p AS lu, last_value(place IGNORE NULLS) OVER p AS lp,
         first_value(CASE WHEN place IS NOT NULL THEN epoch_us(date) END IGNORE NULLS) OVER f AS nu, first_value(place IGNORE NULLS) OVER f AS np
       FROM media WINDOW p AS (PARTITION BY library_id ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY library_id ORDER BY date, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) q) m) z""")
def _(t):
    return L.fill_place(t.media).select("library_id", "id", "place", "inferred")


@query("JN-33", ["assets"], """SELECT library_id, burst, pk, row_number() OVER (PARTITION BY library_id, burst ORDER BY CAST(k * 37 % 100 AS INT) DESC, created_s, pk)::INT AS rank, count(*) OVER (PARTITION BY library_id, burst) AS siblings
  FROM assets WHERE burst IS NOT NULL AND NOT trashed""")
def _(t):
    return L.best_of_burst(t.assets.withColumn("score", F.expr("cast(k * 37 % 100 as int)"))).select("library_id", "burst", "pk", "rank", "siblings")


@query("JN-34", ["named_files"], f"""SELECT library_id, id, drift_h FROM (SELECT *, round_even((epoch_us(name_date) - epoch_us(meta_date)) / 3.6e9, 2) AS drift_h FROM {_NAME} s) x WHERE drift_h IS NOT NULL AND drift_h <> 0""")
def _(t):
    return L.name_drift(t.named_files).select("library_id", "id", "drift_h")


@query("TK-02", ["media"], """SELECT library_id, place, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY n DESC, place) AS r FROM (
  SELECT library_id, place, count(*) AS n FROM media WHERE place IS NOT NULL GROUP BY 1, 2) a) b WHERE r <= 6""")
def _(t):
    return L.top_n(L.place_summary(t.media).select("library_id", "place", "n"), 6, ["library_id"], [F.col("n").desc(), "place"])
