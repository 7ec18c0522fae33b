"""The registered queries of the corpus operators and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from framelake.llm.bpe import encode_documents
from framelake.llm.collocations import collocations
from framelake.llm.embeddings import near_duplicate_vectors
from framelake.llm.fingerprint import compare_with_next
from framelake.llm.language import fit_languages, identify_languages, in_fold
from framelake.llm.merkle import manifest
from framelake.llm.packing import pack_documents
from framelake.llm.quality import fit_quality, score_quality
from framelake.llm.simhash import near_duplicates
from framelake.llm.squares import pack_online
from framelake.llm.substrings import dedup_substrings
from framelake.llm.url_filter import url_filter
from framelake.llm.warc import archive_and_index

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_substring_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark, sf_dir):
    return archive_and_index(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), max_bits=4)


def op5_url_filter(spark, sf_dir):
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op6_embedding_dedup(spark, sf_dir):
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_byte_bpe(spark, sf_dir):
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                            outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", in_fold())
    return identify_languages(docs, fit_languages(docs.where("NOT held_out")), keep=("doc_id", "held_out"))


def op9_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", in_fold())
    model = fit_quality(docs.where("NOT held_out"), _table(spark, sf_dir, "labels").where(~in_fold()))
    return score_quality(docs, model, keep=("doc_id", "held_out"))


def op10_fingerprint(spark, sf_dir):
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op11_online_packing(spark, sf_dir):
    return pack_online(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(len(words) - 19)) AS s FROM w WHERE len(words) >= 20),
repeated AS (
  SELECT doc_id, s FROM starts
  QUALIFY row_number() OVER (PARTITION BY array_to_string(words[s + 1:s + 20], ' ') ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM repeated),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, 10 * (k // 8)::INT + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""

OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (
  SELECT f.lang, f.phrase, f.k, f.a, l.a AS l, r.a AS r, n.n, 1000::HUGEINT * f.a * n.n // (l.a::HUGEINT * r.a) AS score, cut
  FROM f, range(1, f.k) AS t(cut)
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(string_split(f.phrase, ' ')[1:cut], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(string_split(f.phrase, ' ')[cut + 1:], ' ')
  JOIN n ON n.lang = f.lang
  QUALIFY row_number() OVER (PARTITION BY f.lang, f.phrase ORDER BY score, cut) = 1),
s AS (SELECT f.lang, f.a, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase FROM f, range(2, f.k) AS t(m), range(1, f.k - m + 2) AS u(i)),
kept AS (SELECT c.* FROM c ANTI JOIN s ON s.lang = c.lang AND s.phrase = c.phrase AND s.a >= c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def _op13_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves and subroots, level by level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    parts = [rf"""d AS (
  SELECT doc_id, source AS g, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
         xor(list_reduce(list_prepend(4294967295, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
             lambda x, e: CASE WHEN e >= 0 THEN xor(x::BIGINT, e::BIGINT) ELSE xor(x::BIGINT >> 1, 3988292384 * (x::BIGINT & 1)) END), 4294967295) % 5 = 0 AS tampered FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h, doc_id, leaf, CASE WHEN tampered THEN low ELSE leaf END AS cur, '' AS sib FROM d)"""]

    def climb(a, key, carry):
        for j in range(levels):
            parts.append(f"{a}r{j} AS (SELECT g, pos // 16 AS run, any_value(n) AS n, string_agg(h, '' ORDER BY pos) AS hs FROM (SELECT DISTINCT g, pos, n, h FROM {a}{j}) GROUP BY g, run)")
            parts.append(f"""{a}{j + 1} AS (SELECT x.g, run AS pos, CASE WHEN x.n > 1 THEN (x.n + 15) // 16 ELSE 1 END AS n, CASE WHEN x.n > 1 THEN sha256(hs) ELSE hs END AS h, {carry},
  CASE WHEN x.n > 1 THEN sha256(hs[:64 * (x.pos % 16)] || cur || hs[64 * (x.pos % 16) + 65:]) ELSE cur END AS cur, sib || CASE WHEN x.n > 1 THEN hs[:64 * (x.pos % 16)] || hs[64 * (x.pos % 16) + 65:] ELSE '' END AS sib
  FROM {a}{j} x JOIN {a}r{j} r ON r.g IS NOT DISTINCT FROM x.g AND r.run = x.pos // 16)""")

    climb("a", "g", "doc_id, leaf")
    parts.append(f"""s AS (SELECT DISTINCT g AS name, h AS subroot FROM a{levels}),
o AS (SELECT *, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s),
t0 AS (SELECT 0 AS g, o.pos, o.n, subroot AS h, doc_id, leaf, subroot, cur, sib FROM a{levels} x JOIN o ON o.name IS NOT DISTINCT FROM x.g)""")
    climb("t", "g", "doc_id, leaf, subroot")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM t{levels}"


OP13_SQL = _op13_sql()

QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_substring_dedup": op2_substring_dedup, "op3_warc": op3_warc, "op4_simhash": op4_simhash, "op5_url_filter": op5_url_filter,
           "op6_embedding_dedup": op6_embedding_dedup, "op7_byte_bpe": op7_byte_bpe, "op8_language": op8_language, "op9_quality": op9_quality, "op10_fingerprint": op10_fingerprint,
           "op11_online_packing": op11_online_packing, "op12_collocations": op12_collocations, "op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op5_url_filter": OP5_SQL, "op12_collocations": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
