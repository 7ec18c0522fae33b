"""Logical tables as fixed projections of the driver's tables. One entry: name -> (inputs, sql), or
(inputs, (spark_sql, duckdb_sql)) where array functions are spelt differently."""

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LO = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, "
       "l_returnflag, l_linestatus, l_shipdate")

VIEWS = {
    "ev": (["events"], """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}"""),
    # ---- capture libraries -------------------------------------------------------------------
    "media": (["ev"], """
        SELECT user_id AS library_id, event_id AS id, CASE WHEN k % 2 = 0 THEN 'photos' ELSE 'folder' END AS source,
               upper(event_type) || '_' || CAST(event_id AS VARCHAR(20)) ||
                 CASE WHEN event_type IN ('click', 'view') THEN '.HEIC' WHEN event_type = 'signup' THEN '.insv' ELSE '.MOV' END AS name,
               CASE WHEN event_type IN ('click', 'view') THEN 'photo' WHEN event_type = 'signup' THEN '360' ELSE 'video' END AS type,
               ts AS date,
               CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 < 3 THEN 'mtime' WHEN k % 10 < 5 THEN 'file-name' ELSE 'exif' END AS date_origin,
               CASE WHEN k % 6 = 0 THEN NULL ELSE 19.0e0 + k / 100.0e0 END AS lat,
               CASE WHEN k % 6 = 0 THEN NULL ELSE -99.0e0 - k / 100.0e0 END AS lon,
               CASE WHEN k % 4 = 0 THEN NULL ELSE 'city_' || CAST(k % 20 AS VARCHAR(5)) END AS place,
               k % 7 = 0 AS favorite, CAST(k % 5 AS INT) AS faces,
               CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value END AS duration_s,
               CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(floor(value * 10000) AS BIGINT) END AS bytes,
               k % 3 <> 0 AS local, k % 50 = 1 AS hidden, k % 25 = 2 AS screenshot, k % 40 = 3 AS trashed,
               CAST(user_id % 3 AS INT) AS person, k
        FROM {ev}"""),
    "media_people": (["media"], """
        SELECT library_id, id, 'p' || CAST(k % 5 AS VARCHAR(5)) AS name FROM {media} WHERE faces > 0
        UNION SELECT library_id, id, 'p' || CAST(person AS VARCHAR(5)) AS name FROM {media} WHERE faces > 0"""),
    # the same media with clock faults: dead battery, a badly set year, a camera hours ahead
    "media_faults": (["media"], """
        SELECT library_id, id, name, type, date_origin, place, duration_s, bytes, k,
               CASE WHEN k = 13 THEN date - INTERVAL 40 YEAR
                    WHEN k IN (50, 51, 52, 53) THEN date - INTERVAL 400 DAY
                    WHEN type = '360' AND library_id % 2 = 0 THEN date + INTERVAL 5 HOUR ELSE date END AS date
        FROM {media}"""),
    # plan entries: (library, seq) is one correction over many ids; a later one that shares an id replaces it whole
    "corrections": (["media"], """
        SELECT library_id, id, CAST(k AS INT) AS seq,
               CASE WHEN k % 3 = 0 THEN 'assign_date' WHEN k % 3 = 1 THEN 'offset_hours' ELSE 'offset_days' END AS action,
               CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 11 AS DOUBLE) - 5.5e0 END AS amount,
               CASE WHEN k % 3 = 0 THEN date + INTERVAL 30 DAY ELSE NULL END AS new_date
        FROM {media} WHERE k % 13 = 0
        UNION ALL
        SELECT library_id, id, 100 AS seq, 'offset_hours' AS action, 2.5e0 AS amount, NULL AS new_date FROM {media} WHERE k % 39 = 0 OR (k = 13 AND id % 2 = 0)"""),
    "raw_times": (["ev"], """
        SELECT user_id AS library_id, event_id AS id, CASE WHEN k % 5 = 4 THEN CAST(event_id AS DOUBLE) * 259.0e0 + 725760000.0e0 ELSE NULL END AS created_s,
               CASE WHEN k % 4 = 1 THEN NULL ELSE CAST((k % 25 - 12) * 1800 AS INT) END AS tz_offset_s,
               CASE CAST(k % 5 AS INT) WHEN 0 THEN substr(CAST(ts AS VARCHAR(40)), 1, 10) WHEN 1 THEN substr(CAST(ts AS VARCHAR(40)), 1, 16)
                    WHEN 2 THEN replace(substr(CAST(ts AS VARCHAR(40)), 1, 19), ' ', 'T') WHEN 3 THEN 'not a date' ELSE NULL END AS text,
               CASE CAST(k % 4 AS INT) WHEN 0 THEN '+08:00' WHEN 1 THEN '-0630' WHEN 2 THEN 'somewhere' ELSE NULL END AS offset_text
        FROM {ev}"""),
    "named_files": (["ev"], """
        SELECT user_id AS library_id, event_id AS id,
               CASE CAST(k % 7 AS INT) WHEN 0 THEN 'IMG_' || d || '_' || t || '.jpg' WHEN 1 THEN substr(s, 1, 10) || ' ' || replace(substr(s, 12, 8), ':', '.') || '.jpg'
                 WHEN 2 THEN 'VID_' || d || '.mp4' WHEN 3 THEN 'IMG_4934.MOV' WHEN 4 THEN 'X_20241399_250000.jpg' WHEN 5 THEN d || '_2' || substr(t, 2, 1) || '9959.insv' ELSE 'P_' || d || '_995959.HEIC' END AS name,
               CASE WHEN k % 5 = 0 THEN ts WHEN k % 5 = 1 THEN ts + INTERVAL 13 HOUR ELSE NULL END AS meta_date, ts + INTERVAL 3 DAY AS mtime,
               CASE WHEN k % 6 = 0 THEN s || '+02:00' WHEN k % 6 = 1 THEN 'broken' ELSE NULL END AS tag_creationdate, CASE WHEN k % 6 < 3 THEN s || 'Z' ELSE NULL END AS tag_creation_time,
               CASE WHEN k % 6 = 3 THEN substr(s, 1, 10) ELSE NULL END AS tag_date, event_type, k
        FROM (SELECT *, replace(substr(CAST(ts AS VARCHAR(40)), 1, 10), '-', '') AS d, replace(substr(CAST(ts AS VARCHAR(40)), 12, 8), ':', '') AS t, substr(CAST(ts AS VARCHAR(40)), 1, 19) AS s FROM {ev}) x"""),
    "raw_places": (["ev"], """
        SELECT user_id AS library_id, event_id AS id, CASE CAST(k % 5 AS INT) WHEN 0 THEN -180.0e0 WHEN 1 THEN 0.0e0 WHEN 2 THEN 10.5e0 ELSE NULL END AS lat,
               CASE CAST(k % 5 AS INT) WHEN 0 THEN -180.0e0 WHEN 1 THEN CAST(k % 2 AS DOUBLE) WHEN 2 THEN 20.25e0 ELSE NULL END AS lon,
               CAST(k % 60 AS DOUBLE) AS lat_d, CAST(k % 59 AS DOUBLE) AS lat_m, CASE WHEN k % 10 = 3 THEN value ELSE NULL END AS lat_s, CASE WHEN k % 2 = 0 THEN 's' ELSE 'N' END AS lat_ref,
               CAST(k AS DOUBLE) AS lon_d, CAST(k % 31 AS DOUBLE) AS lon_m, 30.0e0 AS lon_s, CASE WHEN k % 4 = 0 THEN 'E' ELSE 'W' END AS lon_ref,
               CASE WHEN k % 7 = 0 THEN '+19.4326-099.1332/' WHEN k % 7 = 1 THEN ' -33+151.5CRS' WHEN k % 7 = 2 THEN 'nowhere' ELSE NULL END AS iso6709
        FROM {ev}"""),
    "assets": (["media"], """
        SELECT library_id, id AS pk, 'u' || CAST(id AS VARCHAR(20)) AS uuid,
               CAST(id AS DOUBLE) * 259.0e0 + 725760000.0e0 AS created_s,
               CASE WHEN type = 'photo' THEN 0 ELSE 1 END AS kind, favorite, hidden, trashed, screenshot,
               CASE WHEN k % 6 = 0 THEN -180.0e0 ELSE lat END AS lat, CASE WHEN k % 6 = 0 THEN -180.0e0 ELSE lon END AS lon,
               CASE WHEN k % 8 = 0 THEN NULL ELSE name END AS filename, CAST(1000 + k * 30 AS INT) AS width, CAST(1000 + (k % 20) * 90 AS INT) AS height,
               duration_s, CASE WHEN k % 10 < 4 THEN 'b' || CAST(library_id AS VARCHAR(10)) || '-' || CAST(k AS VARCHAR(5)) ELSE NULL END AS burst, k
        FROM {media}"""),
    "asset_attrs": (["media"], """
        SELECT library_id, id AS asset, CASE WHEN k % 4 = 1 THEN NULL ELSE CAST((k % 25 - 12) * 1800 AS INT) END AS tz_offset_s,
               'Zone/' || CAST(k % 25 AS VARCHAR(5)) AS tz_name, 'orig_' || name AS original_name, bytes AS original_size
        FROM {media} WHERE k % 12 <> 5"""),
    "detected_faces": (["media"], """
        SELECT library_id, id AS asset, CAST(k % 6 AS BIGINT) AS person, (k % 100) / 100.0e0 AS cx, (k * 7 % 100) / 100.0e0 AS cy,
               (1 + k % 20) / 100.0e0 AS size, k % 17 = 0 AS in_trash FROM {media} WHERE faces > 0
        UNION ALL
        SELECT library_id, id AS asset, CAST(library_id % 6 AS BIGINT) AS person, (k * 3 % 100) / 100.0e0 AS cx, (k * 5 % 100) / 100.0e0 AS cy,
               (1 + k % 9) / 100.0e0 AS size, FALSE AS in_trash FROM {media} WHERE faces > 1"""),
    "persons": (["media"], """
        SELECT DISTINCT library_id, CAST(k % 6 AS BIGINT) AS pk,
               CASE WHEN k % 6 IN (4, 5) THEN NULL ELSE 'Person ' || CAST(k % 6 AS VARCHAR(5)) END AS full_name,
               CASE WHEN k % 6 = 5 THEN NULL ELSE 'P' || CAST(k % 6 AS VARCHAR(5)) END AS display_name FROM {media}"""),
    "resources": (["media"], """
        SELECT library_id, id AS asset, CAST(k % 3 AS INT) AS resource_type, CASE WHEN local THEN 1 ELSE 0 END AS availability, bytes AS data_length FROM {media}
        UNION ALL
        SELECT library_id, id AS asset, 0 AS resource_type, CAST(k % 2 AS INT) AS availability, bytes * 2 AS data_length FROM {media} WHERE k % 5 = 0"""),
    "place_rows": (["media"], """
        SELECT library_id, id, pos, CAST(code AS INT) AS code, name, area FROM (
          SELECT library_id, id, 0 AS pos, 1 AS code, 'Country' || CAST(library_id % 9 AS VARCHAR(5)) AS name, CAST(k AS DOUBLE) AS area FROM {media}
          UNION ALL SELECT library_id, id, 1, 1, 'C' || CAST(k % 3 AS VARCHAR(5)), CAST(CASE WHEN k % 10 = 4 THEN k ELSE 0 END AS DOUBLE) FROM {media}
          UNION ALL SELECT library_id, id, 2, CASE WHEN k % 3 = 0 THEN 6 ELSE 4 END, place, 10.0e0 FROM {media}
          UNION ALL SELECT library_id, id, 3, 4, 'Old' || CAST(k % 4 AS VARCHAR(5)), CAST(k % 21 AS DOUBLE) FROM {media} WHERE k % 2 = 1
          UNION ALL SELECT library_id, id, 4, 99, 'x', 99.0e0 FROM {media}) s"""),
    # ---- published posts ---------------------------------------------------------------------
    "posts": (["orders", "lineitem", "customer"], """
        SELECT o.o_orderkey AS id, o.o_orderdate AS published, o.o_orderpriority AS platform, c.c_mktsegment AS format,
               o.o_orderstatus AS hook, l.close AS close, CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE 'voice' || CAST(o.o_custkey % 4 AS VARCHAR(5)) END AS voice,
               CASE WHEN o.o_custkey % 10 = 0 THEN NULL ELSE l.qty / 4 END AS duration_s,
               CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS views,
               CAST(floor(l.qty) AS BIGINT) AS saves, l.likes AS likes, CASE WHEN o.o_custkey % 3 = 0 THEN NULL ELSE l.n * 3 END AS comments,
               CAST(NULL AS BIGINT) AS shares, CAST(NULL AS BIGINT) AS followers,
               CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE l.watch_pct END AS watch_pct,
               CASE WHEN o.o_custkey % 10 = 5 THEN l.qty / 9 ELSE NULL END AS avg_watch_s,
               CASE WHEN o.o_custkey % 2 = 0 THEN '0:100,2:' || CAST(60 + o.o_custkey % 40 AS VARCHAR(5)) || '%, 5.5:' || CAST(20 + o.o_custkey % 30 AS VARCHAR(5)) ||
                 CASE WHEN o.o_custkey % 26 = 0 THEN ',oops' ELSE '' END ELSE NULL END AS retention_text
        FROM {orders} o JOIN (SELECT l_orderkey, max(l_returnflag) AS close, sum(l_quantity) AS qty, count(*) AS n,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS likes,
               CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) * 10.0e0 / count(*) AS watch_pct FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
             JOIN {customer} c ON c.c_custkey = o.o_custkey"""),
    "scores": (["lineitem"], """
        SELECT post_id, criterion, max(score) AS score FROM (
          SELECT l_orderkey AS post_id,
             CASE CAST((l_linenumber * 3 + l_suppkey) % 16 AS INT) WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'A3' WHEN 3 THEN 'B1' WHEN 4 THEN 'B2' WHEN 5 THEN 'B3' WHEN 6 THEN 'C1' WHEN 7 THEN 'C2' WHEN 8 THEN 'C3' WHEN 9 THEN 'D1' WHEN 10 THEN 'D2' WHEN 11 THEN 'D3' WHEN 12 THEN 'E1' WHEN 13 THEN 'E2' WHEN 14 THEN 'F1' ELSE 'F2' END AS criterion,
             CAST(l_quantity AS BIGINT) % 11 AS score FROM {lineitem}) s GROUP BY post_id, criterion"""),
    # ---- catalogued moments ------------------------------------------------------------------
    "moments": (["lineitem", "part"], f"""
        SELECT l_suppkey AS project_id, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(5)) AS raw_id,
               CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(5)) || '-' || CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LO}) AS VARCHAR(5)) AS id,
               'lib/f' || CAST(l_partkey AS VARCHAR(20)) || CASE WHEN p_size % 3 = 0 THEN '.jpg' WHEN p_size % 3 = 1 THEN '.mov' ELSE '.insv' END AS path,
               CASE WHEN p_size % 3 = 0 THEN 'photo' WHEN p_size % 3 = 1 THEN 'video' ELSE '360' END AS type,
               l_shipdate AS date, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS place, p_brand AS location, CASE WHEN p_size % 4 = 0 THEN ' ' || lower(p_brand) || ' ' ELSE NULL END AS city, p_name AS description,
               l_quantity AS start_s, l_quantity + l_discount * 40 AS end_s,
               CAST(1 + p_size % 5 AS INT) AS quality, CAST(1 + l_suppkey % 5 AS INT) AS hook,
               CASE WHEN l_returnflag = 'N' THEN FALSE WHEN l_returnflag = 'R' THEN TRUE ELSE NULL END AS use,
               p_size % 4 = 0 AS favorite, l_linenumber = 7 AS missing, l_orderkey % 2 = 0 AS subject_present,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE
                 CASE CAST(l_suppkey % 9 AS INT) WHEN 0 THEN 'laughter' WHEN 1 THEN 'surprise' WHEN 2 THEN 'joy' WHEN 3 THEN 'awe' WHEN 4 THEN 'tender' WHEN 5 THEN 'fear' WHEN 6 THEN 'tension' WHEN 7 THEN 'pride' ELSE 'none' END END AS emotion,
               l_tax > 0.04 AS reaction, l_discount > 0.06 AS real_voice, l_linestatus = 'O' AS candid,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_orderkey % 4 AS INT) END AS story_potential,
               CAST(l_partkey % 360 AS DOUBLE) + l_linenumber * 20 AS yaw, CAST(l_orderkey % 12 AS INT) AS batch,
               CASE WHEN p_size % 5 = 0 THEN 'old note' ELSE NULL END AS notes, l_partkey AS partkey, l_orderkey AS orderkey
        FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey"""),
    # ---- rendered videos ---------------------------------------------------------------------
    "shots": (["lineitem"], f"""
        SELECT l_orderkey AS video_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) - 1 AS INT) AS i,
               coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10 AS t0,
               sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10 AS t1,
               l_quantity / 10 AS dur, l_partkey AS src, l_suppkey AS moment, l_returnflag = 'R' AS hero, l_quantity AS start_s,
               l_discount, l_tax, l_linestatus, l_suppkey, l_partkey
        FROM {{lineitem}}"""),
    "captions": (["shots", "part"], """
        SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INT) AS i, i AS shot, t0 + l_discount AS t0,
               t0 + l_discount + l_tax * 50 + 0.5e0 AS t1, p_name AS text, l_suppkey % 9 = 0 AS pin,
               CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'box' WHEN 1 THEN 'serif' WHEN 2 THEN 'clean' ELSE 'pin' END AS style
        FROM {shots} JOIN {part} ON p_partkey = l_partkey WHERE l_linestatus = 'O'"""),
    "voice_lines": (["shots", "part"], """
        SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INT) AS i, i AS shot, t0 + l_discount AS t0,
               t0 + l_discount + l_tax * 50 + 0.5e0 AS t1, p_name AS text, l_suppkey, l_partkey
        FROM {shots} JOIN {part} ON p_partkey = l_partkey WHERE l_linestatus = 'F'"""),
    "heard": (["voice_lines"], ("""
        SELECT video_id, i, CAST(p AS INT) AS pos, w, t0 + p * 0.3e0 AS t0, t0 + p * 0.3e0 + 0.25e0 AS t1, l_suppkey % 3 <> 0 AS ok
        FROM {voice_lines} LATERAL VIEW posexplode(split(text, ' ')) x AS p, w""", """
        SELECT video_id, i, CAST(p AS INT) AS pos, w, t0 + p * 0.3e0 AS t0, t0 + p * 0.3e0 + 0.25e0 AS t1, l_suppkey % 3 <> 0 AS ok
        FROM (SELECT *, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM {voice_lines}) x""")),
    "videos": (["shots", "orders"], """
        SELECT s.video_id, s.end_s AS picture_s, s.end_s + (o.o_custkey % 9 - 4) * 0.15e0 AS audio_s, CASE WHEN o.o_custkey % 9 = 0 THEN NULL ELSE s.end_s + (o.o_custkey % 7 - 3) * 0.2e0 END AS expected_s,
               CAST(CASE WHEN o.o_custkey % 11 = 0 THEN 2 WHEN o.o_custkey % 23 = 0 THEN 0 ELSE 1 END AS INT) AS audio_tracks,
               CASE WHEN o.o_custkey % 17 = 0 THEN NULL ELSE -0.1e0 * (o.o_custkey % 20) END AS peak_db,
               CAST(floor(o.o_totalprice * 1000) AS BIGINT) AS file_bytes, o.o_custkey, o.o_orderpriority,
               o.o_custkey % 10 = 0 AS loop, CASE WHEN o.o_custkey % 40 = 0 THEN NULL ELSE CAST(o.o_custkey % 40 AS DOUBLE) END AS seam_db, CASE WHEN o.o_custkey % 16 = 0 THEN NULL ELSE CAST(o.o_custkey % 15 AS DOUBLE) END AS taper_db,
               CASE WHEN o.o_custkey % 6 = 0 THEN 0.5e0 ELSE 0e0 END AS fade_out, CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE (o.o_custkey % 50) * 1e0 END AS preview_mb
        FROM (SELECT video_id, max(t1) AS end_s FROM {shots} GROUP BY video_id) s JOIN {orders} o ON o.o_orderkey = s.video_id"""),
    # ---- text --------------------------------------------------------------------------------
    "words": (["conversations"], ("""
        SELECT script_id, segment, pos, w, CAST(before AS DOUBLE) * 0.06e0 AS t0, CAST(before + length(w) AS DOUBLE) * 0.06e0 AS t1, (length(w) % 10) / 10.0e0 AS p FROM (
          SELECT conv_id AS script_id, CAST(turn AS INT) AS segment, CAST(k AS INT) AS pos, w,
            coalesce(sum(length(w) + 1 + CASE WHEN length(w) % 7 = 0 THEN 6 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM {conversations} LATERAL VIEW posexplode(split(text, ' ')) x AS k, w) s""", """
        SELECT script_id, segment, pos, w, CAST(before AS DOUBLE) * 0.06e0 AS t0, CAST(before + length(w) AS DOUBLE) * 0.06e0 AS t1, (length(w) % 10) / 10.0e0 AS p FROM (
          SELECT conv_id AS script_id, CAST(turn AS INT) AS segment, CAST(k AS INT) AS pos, w,
            coalesce(sum(length(w) + 1 + CASE WHEN length(w) % 7 = 0 THEN 6 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM {conversations}) x) s""")),
    "lines": (["documents"], ("""
        SELECT doc_id, CAST(n AS INT) AS n, line AS text, lang, source FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS n, line""", """
        SELECT doc_id, CAST(n AS INT) AS n, line AS text, lang, source FROM (
          SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM {documents}) x""")),
    "pref_lists": (["orders"], """
        SELECT o_custkey AS owner, 'formats' AS section, CASE WHEN min(o_orderstatus) = 'F' THEN 'worked' ELSE 'failed' END AS leaf, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'other ' || o_orderpriority ELSE o_orderpriority END AS value
        FROM {orders} GROUP BY o_custkey, o_orderpriority"""),
    "pref_changes": (["orders"], """
        SELECT o_custkey AS owner, 'formats' AS section, CASE WHEN o_orderkey % 2 = 0 THEN 'worked' ELSE 'failed' END AS leaf,
               CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS value, o_orderkey AS seq FROM {orders}"""),
    "rules": (["orders"], """
        SELECT o_custkey AS owner, 'r-' || substr(CAST(1000 + o_orderkey % 900 AS VARCHAR(10)), 2, 3) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Keep ' ELSE 'Always keep ' END || o_orderpriority AS text, 'do' AS kind, CAST(o_orderkey % 3 AS INT) AS hits
        FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM {orders} GROUP BY o_custkey, o_orderpriority) x"""),
    "new_rules": (["orders"], """
        SELECT o_custkey AS owner, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'keep ' ELSE 'Keep ' END || o_orderpriority AS text,
               CASE WHEN o_orderstatus = 'F' THEN 'never' ELSE 'do' END AS kind FROM {orders}"""),
    "facts": (["benchmark"], ("""
        SELECT 'src' || CAST(item_id % 8 AS VARCHAR(5)) AS project, item_id AS fact, concat(split(text, ' ')[0], ' ', split(text, ' ')[1]) AS forbid, element_at(split(text, ' '), -1) AS allow_if FROM {benchmark}
        UNION ALL SELECT 'src' || CAST(item_id % 8 AS VARCHAR(5)), item_id, concat(split(text, ' ')[2], '( a| the|,)? ', split(text, ' ')[3]), element_at(split(text, ' '), -1) FROM {benchmark}""", """
        SELECT 'src' || CAST(item_id % 8 AS VARCHAR(5)) AS project, item_id AS fact, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS forbid, string_split(text, ' ')[-1] AS allow_if FROM {benchmark}
        UNION ALL SELECT 'src' || CAST(item_id % 8 AS VARCHAR(5)), item_id, string_split(text, ' ')[3] || '( a| the|,)? ' || string_split(text, ' ')[4], string_split(text, ' ')[-1] FROM {benchmark}""")),
    "place_facts": (["pages"], """
        SELECT page_id, 1 + page_id % 7 AS project_id, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'economy' WHEN 1 THEN 'Small' WHEN 2 THEN 'LARGE' WHEN 3 THEN 'brand#1' WHEN 4 THEN 'Brand#2' ELSE 'nowhere' END AS place,
               CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'price' WHEN 1 THEN 'time' WHEN 2 THEN 'how' WHEN 3 THEN 'tip' WHEN 4 THEN 'mistake' WHEN 5 THEN 'number' WHEN 6 THEN 'gossip' ELSE NULL END AS kind,
               html AS text, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS source,
               CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST('2026-01-01' AS DATE) - CAST(page_id % 200 AS INT) END AS seen FROM {pages}"""),
    # ---- disk and library state of the catalogue ---------------------------------------------
    "project_parts": (["lineitem", "part"], "SELECT DISTINCT l_suppkey AS project_id, p_partkey, p_size FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"),
    # the same file names in many projects, with other files missing in each
    "files": (["project_parts"], """
        SELECT project_id, CASE WHEN r % 5 <> 0 THEN 'lib/f' || k || ext WHEN r % 3 = 0 THEN '/p/proj/new/F' || k || ext ELSE '/q/old/proxy-f' || k || '_small' || ext END AS path,
               p_size * 1000 AS bytes, CAST(p_size AS DOUBLE) AS duration_s FROM (SELECT *, p_partkey + project_id AS r, CAST(p_partkey AS VARCHAR(20)) AS k, CASE WHEN p_size % 3 = 0 THEN '.jpg' WHEN p_size % 3 = 1 THEN '.mov' ELSE '.insv' END AS ext FROM {project_parts}) x
        WHERE r % 5 <> 0 OR r % 3 < 2
        UNION ALL
        SELECT project_id, CASE WHEN p_size % 2 = 0 THEN '/p/v3/c1/resources/f' ELSE '/z/f' END || CAST(p_partkey AS VARCHAR(20)) || CASE WHEN p_size % 3 = 0 THEN '.jpg' WHEN p_size % 3 = 1 THEN '.mov' ELSE '.insv' END, p_size * 900, CAST(p_size AS DOUBLE) + 20 FROM {project_parts} WHERE (p_partkey + project_id) % 3 = 0"""),
    "library_names": (["project_parts"], """
        SELECT project_id, 'F' || CAST(p_partkey AS VARCHAR(20)) || CASE WHEN p_size % 3 = 0 THEN '.jpg' WHEN p_size % 3 = 1 THEN '.MOV' ELSE '.insv' END AS original_name, 'U-' || CAST(project_id AS VARCHAR(20)) || '-' || CAST(p_partkey AS VARCHAR(20)) AS uuid, p_partkey % 2 = 1 AS trashed FROM {project_parts}"""),
    "vetoes": (["lineitem"], "SELECT DISTINCT l_suppkey AS project_id, CAST(l_quantity AS BIGINT) AS n FROM {lineitem} WHERE CAST(l_quantity AS BIGINT) % 7 = 0"),
    "used_ids": (["lineitem"], """
        SELECT DISTINCT l_suppkey AS project_id, CASE WHEN l_partkey % 17 = 0 THEN 'zz' ELSE '' END || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(5)) || '-1' AS id FROM {lineitem}"""),
    "cuts": (["moments"], "SELECT project_id, id, orderkey AS video_id, start_s + quality - 2 AS cut_start, start_s + quality - 2 + hook * 0.5e0 AS cut_end FROM {moments} WHERE type <> 'photo'"),
    "batch_items": (["moments"], """
        SELECT project_id, id, path, type, date, start_s, end_s, quality, hook, description, batch, place, favorite, use, notes, subject_present, emotion, candid, story_potential, yaw, CASE WHEN type = 'photo' THEN 'b' || CAST(partkey AS VARCHAR(20)) || '-' || CAST(quality AS VARCHAR(5)) ELSE NULL END AS burst FROM {moments}"""),
    "frame_report": (["moments"], """
        SELECT project_id, id, notes, quality, CASE WHEN hook > 3 AND reaction THEN 'foreground_people' ELSE 'glass' END AS obstruction, CASE WHEN subject_present AND quality = 1 THEN 'private_plate' ELSE 'horizontal_edge' END AS finding1,
               'blocking_people at ' || repeat('0', 150) || CAST(quality AS VARCHAR(5)) AS finding2, CASE WHEN quality = 2 THEN NULL ELSE quality END AS at_s FROM {moments}"""),
    "live_moments": (["moments"], """
        SELECT project_id, id, CASE WHEN orderkey % 5 = 0 THEN 'ABCDEF12-0000-4000-8000-' || right('000000000000' || CAST(partkey AS VARCHAR(20)), 12) ELSE NULL END AS uuid,
               CASE WHEN orderkey % 5 = 1 THEN 'x/abcdef12-0000-4000-8000-' || right('000000000000' || CAST(partkey AS VARCHAR(20)), 12) || '.jpg' ELSE path END AS path,
               CASE WHEN orderkey % 5 = 2 THEN 'from ABCDEF12-0000-4000-8000-' || right('000000000000' || CAST(partkey AS VARCHAR(20)), 12) ELSE notes END AS notes, quality, favorite, use
        FROM {moments} WHERE type = 'photo'"""),
    "library_map": (["moments"], "SELECT project_id, id, 'ABCDEF12-0000-4000-8000-' || right('000000000000' || CAST(partkey AS VARCHAR(20)), 12) AS uuid FROM {moments} WHERE type = 'photo' AND orderkey % 5 = 3"),
    "live_library": (["part"], """SELECT 'ABCDEF12-0000-4000-8000-' || right('000000000000' || CAST(p_partkey AS VARCHAR(20)), 12) AS uuid, p_partkey % 2 = 0 AS live, CASE WHEN p_partkey % 4 = 0 THEN 'orig/' || CAST(p_partkey AS VARCHAR(20)) || '_3.mov' ELSE NULL END AS local_mov FROM {part}"""),
    "frame_measures": (["lineitem"], ("""
        SELECT l_orderkey AS moment_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY LO) AS INT) AS at_s,
          filter(array(CASE WHEN l_linenumber % 3 > 0 THEN named_struct('axis', CASE WHEN l_suppkey % 2 = 0 THEN 'h' ELSE 'v' END, 'at', 0.3e0 + l_discount, 'len', 0.5e0 + l_tax) END, CASE WHEN l_linenumber % 3 > 1 THEN named_struct('axis', 'v', 'at', 0.6e0, 'len', 0.5e0) END, CASE WHEN l_linenumber % 3 > 1 AND l_suppkey % 3 = 0 THEN named_struct('axis', 'h', 'at', 0.7e0, 'len', 0.5e0) END), x -> x IS NOT NULL) AS crossing_lines,
          CASE WHEN l_partkey % 11 = 0 THEN array('plate') WHEN l_partkey % 11 = 1 THEN array('phone', 'email') END AS private_text,
          l_discount * 6 AS haze, l_quantity + 20 AS contrast, 1 - l_tax * 8 AS clear_band, l_tax * 6 AS people_bottom, l_discount AS people_middle,
          CASE WHEN l_partkey % 3 = 0 THEN array(named_struct('cy', l_suppkey / 100.0e0, 'height_share', l_discount)) ELSE filter(array(named_struct('cy', 0e0, 'height_share', 0e0)), x -> false) END AS faces FROM {lineitem}""".replace("LO", "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"), """
        SELECT l_orderkey AS moment_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY LO) AS INT) AS at_s, CASE WHEN l_suppkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis1, CAST(l_linenumber % 3 AS INT) + CASE WHEN l_linenumber % 3 > 1 AND l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS n_lines, 0.3e0 + l_discount AS at1,
          CASE WHEN l_partkey % 11 = 0 THEN ['private_plate'] WHEN l_partkey % 11 = 1 THEN ['private_phone', 'private_email'] ELSE [] END AS priv,
          l_discount * 6 AS haze, l_quantity + 20 AS contrast, 1 - l_tax * 8 AS clear_band, l_tax * 6 AS people_bottom, l_discount AS people_middle, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey / 100.0e0 END AS face_cy, l_discount AS face_h FROM {lineitem}""".replace("LO", "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))),
    # camera swing and subject motion of short live clips, ten samples a second
    "motion_samples": (["ev"], """
        SELECT user_id * 1000000 + CAST(floor(event_id / 400) AS BIGINT) AS clip_id, CAST(row_number() OVER (PARTITION BY user_id * 1000000 + CAST(floor(event_id / 400) AS BIGINT) ORDER BY ts, event_id) - 1 AS INT) AS i,
               k / 200.0e0 AS camera, value / 40 AS subject FROM {ev}"""),
    # ---- measurements of rendered videos -----------------------------------------------------
    "totals": (["videos"], "SELECT video_id, picture_s AS total_s FROM {videos}"),
    "level_samples": (["totals"], ("""
        SELECT video_id, j * 0.5e0 AS t, -20e0 - CAST((video_id * 7 + j * 13) % 30 AS DOUBLE) AS db FROM {totals} LATERAL VIEW explode(sequence(0L, CAST(floor(total_s * 2) AS BIGINT))) x AS j""", """
        SELECT video_id, j * 0.5e0 AS t, -20e0 - CAST((video_id * 7 + j * 13) % 30 AS DOUBLE) AS db FROM (SELECT video_id, unnest(range(CAST(floor(total_s * 2) AS BIGINT) + 1)) AS j FROM {totals}) x""")),
    "frame_stats": (["totals"], ("""
        SELECT video_id, j * 0.25e0 AS t, CASE WHEN video_id % 7 = 0 THEN 0.01e0 ELSE CAST((video_id * 3 + j * 11) % 50 AS DOUBLE) / 25 END AS d,
          CASE WHEN video_id % 2 = 0 AND total_s - j * 0.25e0 < 1 + video_id % 3 THEN (total_s - j * 0.25e0) * 35 WHEN (video_id + j) % 97 = 0 THEN NULL ELSE 80e0 + CAST((video_id * 7 + j * 13) % 40 AS DOUBLE) END AS y
        FROM {totals} LATERAL VIEW explode(sequence(0L, CAST(floor(total_s * 4) AS BIGINT))) x AS j""", """
        SELECT video_id, j * 0.25e0 AS t, CASE WHEN video_id % 7 = 0 THEN 0.01e0 ELSE CAST((video_id * 3 + j * 11) % 50 AS DOUBLE) / 25 END AS d,
          CASE WHEN video_id % 2 = 0 AND total_s - j * 0.25e0 < 1 + video_id % 3 THEN (total_s - j * 0.25e0) * 35 WHEN (video_id + j) % 97 = 0 THEN NULL ELSE 80e0 + CAST((video_id * 7 + j * 13) % 40 AS DOUBLE) END AS y
        FROM (SELECT *, unnest(range(CAST(floor(total_s * 4) AS BIGINT) + 1)) AS j FROM {totals}) x""")),
    "silence_events": (["shots"], """
        SELECT video_id, 'start' AS kind, t0 - 0.05e0 AS t FROM {shots} WHERE l_suppkey % 5 = 0
        UNION ALL SELECT video_id, 'end' AS kind, t0 - 0.05e0 + l_tax * 14 AS t FROM {shots} WHERE l_suppkey % 5 = 0 AND l_suppkey <> 10"""),
    "black_events": (["shots"], "SELECT video_id, t1 AS t0, t1 + 0.1e0 AS t1 FROM {shots} WHERE l_suppkey % 50 = 7"),
    "scene_features": (["shots", "part"], ("""
        SELECT video_id, i, dur, l_discount * 8 AS luma, l_tax * 8 AS dark, l_tax AS neon, dur / 10 AS snow, l_discount * 3 AS autumn, l_tax * 3 AS green, dur / 25 AS water, l_discount * 2 AS warm_cast, l_tax * 3 AS sky_blue, dur / 8 AS sky_grey,
          filter(array(CASE l_suppkey % 8 WHEN 0 THEN 'food' WHEN 1 THEN 'interior' WHEN 2 THEN 'water' END), x -> x IS NOT NULL) AS tags FROM {shots} JOIN {part} ON p_partkey = l_partkey""", """
        SELECT video_id, i, dur, l_discount * 8 AS luma, l_tax * 8 AS dark, l_tax AS neon, dur / 10 AS snow, l_discount * 3 AS autumn, l_tax * 3 AS green, dur / 25 AS water, l_discount * 2 AS warm_cast, l_tax * 3 AS sky_blue, dur / 8 AS sky_grey,
          CASE l_suppkey % 8 WHEN 0 THEN 'food' WHEN 1 THEN 'interior' WHEN 2 THEN 'water' ELSE '' END AS tag FROM {shots} JOIN {part} ON p_partkey = l_partkey""")),
    # ---- edit plans --------------------------------------------------------------------------
    "edit_shots": (["shots"], """
        SELECT video_id AS variant_id, i, CASE WHEN l_suppkey % 10 <> 0 THEN 1 + CAST(dur * 10 AS BIGINT) % 4 ELSE NULL END AS beats, CASE WHEN l_suppkey % 10 = 0 OR l_linestatus = 'O' THEN dur ELSE NULL END AS dur,
               CASE WHEN l_linestatus = 'F' THEN i ELSE NULL END AS line, CASE WHEN l_linestatus = 'F' THEN 0.5e0 + l_discount * 10 ELSE NULL END AS line_s, start_s, hero, l_partkey % 3 <> 0 AS splittable FROM {shots}"""),
    "music": (["orders"], "SELECT o_orderkey AS variant_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 60e0 + o_custkey % 100 END AS bpm, (o_custkey % 10) / 10e0 AS beat0 FROM {orders}"),
    "spec_segments": (["shots", "orders"], """
        SELECT video_id, i, CASE WHEN o_custkey % 2 = 0 THEN 1e0 + i % 3 ELSE NULL END AS beats, CASE WHEN o_custkey % 2 = 1 AND NOT (o_custkey % 9 = 1 AND i = 1) THEN dur ELSE NULL END AS dur, 60e0 + o_custkey % 60 AS bpm, (o_custkey % 4) / 8e0 AS beat0, 'm/clip' || CAST(src AS VARCHAR(20)) || '.mov' AS src
        FROM {shots} JOIN {orders} ON o_orderkey = video_id"""),
    "seg_captions": (["captions"], """
        SELECT video_id, i, CASE WHEN i % 5 = 4 THEN NULL WHEN i % 3 = 1 THEN -1 ELSE shot END AS seg_from, CASE WHEN i % 5 = 4 THEN NULL WHEN i % 3 = 1 THEN -1 WHEN i % 4 = 2 THEN shot + 1 ELSE shot END AS seg_to, CASE WHEN pin THEN 0.15e0 ELSE NULL END AS lead, CASE WHEN style = 'box' THEN 0.3e0 ELSE NULL END AS tail,
               CASE WHEN i % 5 = 4 AND NOT pin THEN t0 ELSE NULL END AS t0, CASE WHEN i % 5 = 4 THEN t1 ELSE NULL END AS t1 FROM {captions}"""),
    "clip_subs": (["part"], "SELECT p_partkey AS src, 0 AS sub, p_size / 2e0 AS t0, p_size / 2e0 + 2 AS t1, p_name AS text FROM {part} UNION ALL SELECT p_partkey AS src, 1 AS sub, p_size / 2e0 + 2.1e0 AS t0, p_size / 2e0 + 2.4e0 AS t1, p_type AS text FROM {part}"),
    "clip_segs": (["shots"], "SELECT video_id, i, src, start_s / 2 AS start_s, 1e0 + l_suppkey % 2 AS speed, t0 AS g0, t1 AS g1 FROM {shots}"),
    "text_samples": (["ev"], "SELECT user_id * 1000000 + CAST(floor(event_id / 400) AS BIGINT) AS clip_id, event_id AS t, CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN event_type = 'click' THEN 'view' ELSE event_type END AS text FROM {ev}"),
    "segments": (["lines"], "SELECT doc_id, n, n * 9e0 AS t0, n * 9e0 + length(text) * 0.07e0 AS t1, text, -1e0 * (length(text) % 13) / 10 AS avg_logprob, (length(text) % 11) / 10e0 AS no_speech FROM {lines}"),
    "script_rows": (["lines"], """
        SELECT doc_id AS script_id, n, CASE WHEN n % 9 = 8 THEN '## Notes:' WHEN n % 7 = 5 THEN '---' WHEN n % 5 = 4 THEN text WHEN n % 5 = 3 THEN '[' || CAST(n AS VARCHAR(9)) || '.25] s |  ~2.4 s  ' || text WHEN n % 6 = 2 THEN CAST(n AS VARCHAR(9)) || '   ' || substr(text, 1, 6) WHEN n % 11 = 10 THEN '3 line text and so on' ELSE CAST(n AS VARCHAR(9)) || '.5  ' || text END AS line FROM {lines}"""),
    "script_silences": (["words"], "SELECT script_id, t1 + 0.15e0 AS start, t1 + 0.65e0 AS e FROM {words} WHERE length(w) % 9 = 0"),
    "talk_lines": (["voice_lines"], "SELECT video_id, i, CASE WHEN i % 4 = 3 THEN NULL ELSE t0 END AS start_s, CASE WHEN i % 3 = 2 THEN NULL ELSE t1 - t0 END AS duration_s, text FROM {voice_lines}"),
    "timed_lines": (["voice_lines"], "SELECT video_id, i, t0 AS start_s, CASE WHEN i % 3 = 2 THEN NULL ELSE t1 - t0 END AS duration_s, text FROM {voice_lines}"),
    "tracks": (["pages"], """SELECT page_id, CASE CAST(page_id % 9 AS INT) WHEN 0 THEN ' Voice ' WHEN 1 THEN 'FX' WHEN 2 THEN 'music' WHEN 3 THEN '' ELSE NULL END AS role,
        CASE CAST(page_id % 5 AS INT) WHEN 0 THEN url WHEN 1 THEN 'a/sfx/' || CAST(page_id AS VARCHAR(9)) || '.wav' WHEN 2 THEN 'take/l' || CAST(page_id AS VARCHAR(9)) || '.wav' WHEN 3 THEN 'A/Narration/x.wav' ELSE NULL END AS src FROM {pages}"""),
    "ocr_words": (["shots", "part"], """
        SELECT video_id AS frame, upper(substr(p_name, 1, 2)) AS text, 0.9e0 AS conf, 0.1e0 AS x0, i / 8e0 AS y0, 0.18e0 AS x1, i / 8e0 + 0.05e0 AS y1 FROM {shots} JOIN {part} ON p_partkey = l_partkey
        UNION ALL SELECT video_id, CAST(1000 + l_partkey % 9000 AS VARCHAR(9)), CASE WHEN l_suppkey % 7 = 0 THEN 0.3e0 ELSE 0.8e0 END, 0.2e0 + l_tax, i / 8e0 + 0.01e0, 0.3e0 + l_tax, i / 8e0 + 0.06e0 FROM {shots}"""),
    "lexicons": (["benchmark"], ("""
        SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, 0 AS layer, split(text, ' ')[1] AS term, 'say1' AS say FROM {benchmark}
        UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END, 1, concat(split(text, ' ')[1], ' ', split(text, ' ')[2]), 'say2' FROM {benchmark}
        UNION ALL SELECT 'en', 2, lower(split(text, ' ')[1]), 'say3' FROM {benchmark} WHERE item_id % 4 = 0""", """
        SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, 0 AS layer, string_split(text, ' ')[2] AS term, 'say1' AS say FROM {benchmark}
        UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END, 1, string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3], 'say2' FROM {benchmark}
        UNION ALL SELECT 'en', 2, lower(string_split(text, ' ')[2]), 'say3' FROM {benchmark} WHERE item_id % 4 = 0""")),
    # ---- concepts, builds and reviews --------------------------------------------------------
    "c_head": (["videos"], """
        SELECT video_id AS concept_id, o_custkey AS k, o_custkey % 40 AS project_id, picture_s * (1 + (o_custkey % 5 - 2) * 0.2e0) AS target_duration_s, o_custkey % 4 = 0 AS narration,
               CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 6) * 1e0 END AS hook_ends_s, 'r' || CAST(o_custkey % 50 AS VARCHAR(5)) AS hook_resource, 'r' || CAST(o_custkey % 47 AS VARCHAR(5)) AS close_resource,
               CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE picture_s * (o_custkey % 10) / 8 END AS paid_off_s, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE picture_s * (o_custkey % 8) / 6 END AS turn_s,
               CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE picture_s * (o_custkey % 13) / 11 END AS close_s, CASE WHEN o_custkey % 3 = 0 THEN 'beat' ELSE 'free' END AS cut_to,
               CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 30e0 + o_custkey % 200 END AS bpm, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'first_person' WHEN 1 THEN 'recap' WHEN 2 THEN 'place_first' ELSE 'custom' END AS quota_kind,
               (o_custkey % 10) / 10e0 AS max_ratio, CASE WHEN o_custkey % 8 = 0 THEN 0.2e0 ELSE NULL END AS min_ratio, CASE WHEN o_custkey % 9 = 0 THEN 'why' ELSE NULL END AS quota_note, o_custkey % 5 <> 0 AS human_anchor,
               CASE WHEN o_custkey % 10 = 9 THEN 'vlog' WHEN o_custkey % 2 = 0 THEN 'list' ELSE 'character' END AS family, CASE WHEN o_custkey % 12 = 0 THEN 'english' ELSE 'en-US' END AS lang,
               CASE WHEN o_custkey % 15 = 0 THEN 'too short' ELSE 'four beats of about five seconds each' END AS duration_rationale, CASE WHEN o_custkey % 6 < 2 THEN NULL ELSE 's-' || substr(CAST(1000 + o_custkey % 30 AS VARCHAR(5)), 2, 3) END AS story, picture_s,
               CASE WHEN o_custkey % 21 = 0 THEN 'cinema' ELSE 'reels' END AS platform, CASE WHEN o_custkey % 22 = 0 THEN NULL WHEN o_custkey % 22 = 1 THEN 'fade' ELSE 'loop' END AS close_kind, CASE WHEN o_custkey % 23 = 0 THEN -1e0 ELSE 0.5e0 END AS beat0_s,
               CASE WHEN o_custkey % 24 = 0 THEN 'ab' ELSE 'a title' END AS title, CASE WHEN o_custkey % 26 = 0 THEN 'sea' ELSE 'the sea at dawn' END AS hook_visual, CASE WHEN o_custkey % 27 = 0 THEN NULL WHEN o_custkey % 27 = 1 THEN 'a view' ELSE 'what the tram costs' END AS promise,
               CASE WHEN o_custkey % 28 = 0 THEN 'it ends' ELSE 'it answers the opening' END AS lands_because, CASE WHEN o_custkey % 29 = 0 THEN -2e0 ELSE 3e0 END AS anchor_at_s, CASE WHEN o_custkey % 31 = 0 THEN 'a man' ELSE 'a man who laughs' END AS anchor_what FROM {videos}"""),
    "c_blocks": (["shots", "part"], """
        SELECT video_id AS concept_id, i, CASE WHEN l_suppkey % 11 = 0 THEN t0 - 0.2e0 ELSE t0 END AS t0, CASE WHEN l_suppkey % 23 = 0 THEN t0 - 0.3e0 ELSE t1 END AS t1, 'r' || CAST(l_partkey % 50 AS VARCHAR(5)) AS resource,
               CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN i = 0 THEN 'hook' WHEN i = n - 1 AND l_suppkey % 5 > 0 THEN 'close' WHEN l_suppkey % 17 = 0 THEN 'turn' ELSE 'development' END AS role,
               CASE WHEN l_linestatus = 'O' THEN p_name ELSE NULL END AS text, hero AS subject, CASE WHEN l_linestatus = 'F' AND l_suppkey % 3 = 0 THEN p_name ELSE NULL END AS says, l_suppkey, l_partkey
        FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM {shots}) s JOIN {part} ON p_partkey = l_partkey"""),
    "c_beats": (["c_blocks"], "SELECT concept_id, i, CASE WHEN l_suppkey % 9 = 0 THEN t0 - 3 ELSE t0 END AS at_s, 'Raise ' || CAST(l_partkey % 6 AS VARCHAR(5)) AS raises, CASE WHEN l_suppkey % 2 = 0 THEN 'wait' ELSE NULL END AS mini_hook FROM {c_blocks}"),
    "c_variants": (["c_blocks", "c_head"], """
        SELECT b.concept_id, b.i, CASE WHEN l_suppkey % 19 = 0 THEN 'A' WHEN l_suppkey % 19 = 1 THEN 'Z' ELSE substr('ABCDEFGH', b.i + 1, 1) END AS letter, CASE WHEN b.i = 0 THEN 'base' ELSE CASE CAST((l_suppkey + b.i) % 5 AS INT) WHEN 0 THEN 'base' WHEN 1 THEN 'hook' WHEN 2 THEN 'close' WHEN 3 THEN 'voice' ELSE 'shots' END END AS differs_in,
               CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN hook_resource ELSE resource END AS hook_resource, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN close_resource ELSE resource END AS close_resource,
               CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_partkey % 5 = 0 END AS narrated, CASE WHEN l_suppkey % 10 = 3 THEN 'Same cuts, Other song' ELSE 'another middle' END AS what, CAST(l_partkey % 6 AS INT) AS n_new, narration,
               'v' || CAST(b.concept_id AS VARCHAR(20)) || '-' || CAST(b.i AS VARCHAR(3)) AS variant_id, t1 AS duration_s, l_suppkey, l_partkey FROM {c_blocks} b JOIN {c_head} h ON h.concept_id = b.concept_id"""),
    "c_stories": (["c_head"], "SELECT DISTINCT CASE WHEN project_id % 5 = 4 THEN -project_id ELSE project_id END AS project_id, 's-' || substr(CAST(1000 + k % 20 AS VARCHAR(5)), 2, 3) AS id FROM {c_head}"),
    "builds": (["c_variants"], """
        SELECT variant_id, CAST(1 + l_suppkey % 20 AS INT) AS cuts, CAST(l_partkey % 22 AS INT) AS cuts_with_subject, -0.1e0 * (l_partkey % 15) AS peak_dbtp, CASE WHEN l_suppkey % 31 = 0 THEN 2 ELSE 0 END AS black_frames, duration_s AS video_duration_s, duration_s + (l_partkey % 9 - 4) * 0.15e0 AS audio_duration_s,
               CASE WHEN l_suppkey % 29 = 0 THEN 2 WHEN l_suppkey % 29 = 1 THEN NULL ELSE 1 END AS audio_tracks, CASE WHEN l_partkey % 27 = 0 THEN 'm1' ELSE NULL END AS out_of_window, narrated, CASE WHEN l_suppkey % 3 = 0 THEN 'x.json' ELSE NULL END AS voice_script FROM {c_variants}"""),
    "reviews": (["c_variants", "c_head"], """
        SELECT v.concept_id, v.i, v.variant_id, v.letter, CAST(1 + v.l_suppkey % 20 AS INT) AS cuts, CAST(v.l_partkey % (1 + v.l_suppkey % 20) AS INT) AS subject_cuts, h.max_ratio, h.min_ratio, round((v.l_partkey % (1 + v.l_suppkey % 20)) * 1e0 / (1 + v.l_suppkey % 20) + CASE WHEN v.l_partkey % 10 = 0 THEN 0.05e0 ELSE 0 END, 2) AS ratio, v.l_partkey % 3 > 0 AS pass,
               v.l_suppkey % 4 > 0 AS approved, CASE WHEN v.l_partkey % 4 = 0 THEN 'blocks' WHEN v.l_partkey % 4 = 1 THEN 'important' WHEN v.l_partkey % 39 = 2 THEN 'ugly' ELSE 'minor' END AS severity, CASE WHEN v.l_suppkey % 3 = 0 THEN 'open' WHEN v.l_suppkey % 3 = 1 THEN 'fixed' WHEN v.l_suppkey % 41 = 2 THEN 'later' ELSE 'not_fixable' END AS status, CASE WHEN v.l_suppkey % 6 = 2 THEN 'reason' ELSE NULL END AS reason, h.k % 9 <> 0 AS language_ok,
               CASE WHEN v.l_partkey % 33 = 0 THEN 'dark' ELSE 'the cut comes late' END AS what, CASE WHEN v.l_partkey % 34 = 0 THEN '' ELSE '3.2 s' END AS place, CASE WHEN v.l_partkey % 35 = 0 THEN 'trim' ELSE 'trim half a second' END AS how_to_fix,
               CASE WHEN v.l_partkey % 36 = 0 THEN 'B is better' ELSE 'B opens faster and keeps its promise' END AS comparison, CASE WHEN v.l_partkey % 37 = 0 THEN 'J' ELSE 'B' END AS recommended, CASE WHEN v.l_partkey % 38 = 0 THEN '/home/u/readme.md' ELSE 'readme.md' END AS readme
        FROM {c_variants} v JOIN {c_head} h ON h.concept_id = v.concept_id"""),
    "story_reviews": (["c_head"], """
        SELECT concept_id, k, CASE WHEN k % 41 = 5 THEN 'maybe' WHEN k % 3 = 0 THEN 'ship' WHEN k % 3 = 1 THEN 'rework' ELSE 'reject' END AS verdict, CASE WHEN k % 43 = 6 THEN 'mid' WHEN k % 2 = 0 THEN 'pre' ELSE 'post' END AS pass, k % 7 <> 0 AS paid_ok, CASE WHEN k % 5 = 0 THEN NULL ELSE paid_off_s END AS paid_at, k % 6 <> 0 AS close_ok, CAST(k % 3 AS INT) AS n_blocks,
               picture_s AS declared_s, picture_s * (1 + (k % 5 - 2) * 0.1e0) AS recommended_s, CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS n_windows, CAST(k % 8 AS INT) AS n_watched, picture_s * (k % 30) / 10 AS variant_s,
               CASE WHEN k % 31 = 0 THEN 'fade' ELSE 'loop' END AS close_kind, CASE WHEN k % 32 = 0 THEN 'soon' ELSE 'optional' END AS fix_level, CASE WHEN k % 33 = 0 THEN 'A concept' ELSE 'concept-1' END AS concept, CASE WHEN k % 34 = 0 THEN 'I' ELSE 'C' END AS fix_variant,
               CASE WHEN k % 35 = 0 THEN '3+3' ELSE 'three beats of four' END AS in_beats, CASE WHEN k % 36 = 0 THEN 'cut it' ELSE 'cut the second shot' END AS fix_what, CASE WHEN k % 37 = 0 THEN 'slow' ELSE 'it repeats itself' END AS fix_why,
               CASE WHEN k % 38 = 0 THEN -1 ELSE 4 END AS beats, CASE WHEN k % 39 = 0 THEN -0.5e0 ELSE 2e0 END AS largest_gap_s FROM {c_head}"""),
    "variant_results": (["c_variants"], """
        SELECT concept_id, variant_id, letter, l_suppkey % 5 > 0 AS verify_pass, CASE WHEN l_partkey % 8 = 0 THEN FALSE WHEN l_partkey % 8 = 1 THEN NULL ELSE TRUE END AS deliverable, CASE WHEN l_partkey % 6 = 0 THEN 'text_sync,ending' ELSE '' END AS skipped, duration_s, CAST(40 + l_partkey % 60 AS INT) AS rubric_total FROM {c_variants}"""),
    "repairs": (["variant_results"], "SELECT concept_id, CASE WHEN rubric_total % 10 = 0 THEN letter || 'x' ELSE letter END AS letter, TRUE AS verify_pass, rubric_total + 5 AS rubric_total FROM (SELECT concept_id, letter, max(rubric_total) AS rubric_total FROM {variant_results} WHERE rubric_total < 60 GROUP BY concept_id, letter) x"),
    "fixes": (["c_variants"], "SELECT concept_id, letter, CASE WHEN l_suppkey % 3 = 0 THEN 'blocks' ELSE 'optional' END AS level, 'fix ' || CAST(l_suppkey AS VARCHAR(5)) AS what FROM {c_variants} WHERE l_suppkey % 2 = 0"),
    # ---- faces and variants ------------------------------------------------------------------
    "face_embeddings": (["embeddings"], "SELECT CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 + vec_id % 11 END AS g, vec_id AS key, CAST(floor(vec_id / 2) AS BIGINT) AS item, embedding AS vec, label, (vec_id * 7 % 90) / 100e0 AS area_pct, (vec_id * 13 % 100) / 100e0 AS score FROM {embeddings}"),
    "face_refs": (["face_embeddings"], "SELECT g, label AS person, key, vec FROM {face_embeddings}"),
    "spec_shots": (["shots"], """SELECT CAST(floor(video_id / 3) AS BIGINT) AS concept_id, video_id AS variant_id, i, CAST(l_partkey % 12 AS BIGINT) AS src, start_s / 5 AS start_s, dur, video_id % 4 = 0 AS narrated FROM {shots}"""),
    "thumbs": (["spec_shots"], ("""
        SELECT concept_id, variant_id, i, dur, narrated, transform(sequence(0, 31), j -> CAST(CASE WHEN src % 6 = 5 THEN 20 + j % 3 WHEN src % 6 = 4 THEN 120 + j % 2 ELSE (src * 41 + j * (30 + src * 5) + CAST(floor(start_s) AS INT) * 3) % 256 END AS INT)) AS px FROM {spec_shots}""", """
        SELECT concept_id, variant_id, i, dur, narrated, list_transform(range(0, 32), lambda j: CAST(CASE WHEN src % 6 = 5 THEN 20 + j % 3 WHEN src % 6 = 4 THEN 120 + j % 2 ELSE (src * 41 + j * (30 + src * 5) + CAST(floor(start_s) AS INT) * 3) % 256 END AS INT)) AS px FROM {spec_shots}""")),
}
