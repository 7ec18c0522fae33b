"""Faces: subjects, similar pairs, groups, matches against a person."""
from pyspark.sql import Window, functions as F

from framelake.functions.core import exact_sum, let, py_round
from framelake.plans.similarity import average_link, cosine_pairs, written_by, written_once

# Same-person similarity, smallest share of the frame in percent, borderline band.
SAME_PERSON, MIN_FACE_PCT, BAND = 0.363, 0.15, 0.08
# People whose mean vectors are sent to every task (of a few hundred numbers each), and parts of a library beyond that.
REFERENCES, SALTS = 10_000, 64


def big_faces(faces, min_pct=MIN_FACE_PCT):
    return faces.filter(F.col("area_pct") >= min_pct)


def no_face(items, faces, keys, min_pct=MIN_FACE_PCT):
    """Items with no face large enough to be a subject."""
    return items.join(big_faces(faces, min_pct).select(*keys), list(keys), "left_anti")


def face_pairs(e, threshold=SAME_PERSON):
    return cosine_pairs(e.select("g", "key", "vec"), threshold)


def cluster_faces(e, threshold=SAME_PERSON, pairs=None):
    return average_link(e.select("g", "key", "vec"), threshold, pairs)


def cluster_report(e, clusters, min_size=3, best=6):
    """Groups of at least min_size faces with their items and best faces; and how many groups are loose.
    The best six are a ranked limit, applied before the shuffle."""
    j = written_once(e.drop("vec").join(clusters, ["g", "key"]))      # read three times
    n = j.groupBy("g", "cluster").agg(F.count("*").alias("faces"), F.countDistinct("item").alias("items"))
    w = Window.partitionBy("g", "cluster").orderBy(F.col("area_pct").desc(), F.col("score").desc(), "key")
    top = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= best).groupBy("g", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "key"))), lambda x: x["key"]).alias("best"))
    loose = n.groupBy("g").agg(F.count_if(F.col("faces") < min_size).alias("loose"))
    return n.filter(F.col("faces") >= min_size).join(top, ["g", "cluster"]).join(loose, "g")


def reference_vectors(refs):
    """Mean of a person's reference faces, normalised."""
    m = refs.select("g", "person", F.posexplode("vec").alias("p", "x")).groupBy("g", "person", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("g", "person").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("ref", let(norm, lambda n: F.transform("v", lambda x: F.when(n > 0, x / n).otherwise(x)))).drop("v")


def match_faces(e, refs, threshold=SAME_PERSON, band=BAND):
    """Best similarity per item and person: a hit, or borderline just below the threshold. The people of a library are
    its query set, each face is compared with all of them. They are written once and counted: up to REFERENCES of them
    travel to the faces; more are dealt out with the faces by library and salt, so a large library is many tasks."""
    known = written_once(reference_vectors(refs))
    if known.count() <= REFERENCES:
        e, known, on = e, F.broadcast(known), ["g"]
    else:
        e = e.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
        known, on = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "_salt"]
    dot = F.aggregate(F.zip_with("vec", "ref", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    s = e.join(known, on).select("g", "person", "item", dot.alias("similarity")).groupBy("g", "person", "item").agg(F.max("similarity").alias("similarity"))
    kind = F.when(F.col("similarity") >= threshold, "match").when(F.col("similarity") >= threshold - band, "borderline")
    return s.withColumn("kind", kind).filter("kind is not null")


def match_lists(matches):
    """Two lists per person, most similar first."""
    w = Window.partitionBy("g", "person", "kind").orderBy(F.col("similarity").desc(), "item")
    return matches.withColumn("rank", F.row_number().over(w))


# ---- variants of one concept ---------------------------------------------------------------------
def _variants(shots):
    return shots.groupBy("concept_id", "variant_id").agg(F.count("*").alias("n"), exact_sum("dur", 6).alias("len"), F.max("narrated").alias("voiced"))


def _pairs(v):
    """Variants of a concept two by two; a concept holds five at most by contract."""
    a, b = [v.select("concept_id", *[F.col(c).alias(f"{c}_{s}") for c in v.columns if c != "concept_id"]) for s in "ab"]
    return a.join(b, "concept_id").filter("variant_id_a < variant_id_b")


def _verdict(p, share_name):
    share = F.coalesce("shared", F.lit(0)) / F.greatest(F.lit(1), F.least("n_a", "n_b"))
    ratio = F.when(F.greatest("len_a", "len_b") > 0, F.least("len_a", "len_b") / F.greatest("len_a", "len_b")).otherwise(1.0)
    p = p.withColumn("share", share).withColumn("length_ratio", ratio)
    axes = F.array_compact(F.array(F.when(F.col("share") < 0.6, F.lit("shots")), F.when(~F.col("same_hook"), F.lit("hook")), F.when(~F.col("same_close"), F.lit("close")), F.when(F.col("voiced_a") != F.col("voiced_b"), F.lit("voice"))))
    p = p.withColumn("_a", axes)
    axes = F.when((F.size("_a") > 0) & (F.col("length_ratio") <= 0.75), F.concat("_a", F.array(F.lit("length")))).otherwise(F.col("_a"))
    return p.select("concept_id", F.col("variant_id_a").alias("a"), F.col("variant_id_b").alias("b"), F.col("share").alias(share_name), "length_ratio", axes.alias("differs_on"), (F.col("share") < 0.6).alias("ok"))


def compare_specs(shots):
    """Shared shots by file and moment (within a second), and what else a viewer can tell apart."""
    s = shots.withColumn("st", py_round("start_s", 1)).withColumn("_b", F.floor("st"))
    a = s.select("concept_id", "src", F.col("variant_id").alias("va"), F.col("i").alias("ia"), F.col("st").alias("sa"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    b = s.select("concept_id", "src", F.col("variant_id").alias("vb"), F.col("st").alias("sb"), "_b")
    hit = (a.join(b, ["concept_id", "src", "_b"]).filter((F.col("va") < F.col("vb")) & (F.abs(F.col("sa") - F.col("sb")) < 1.0)).select("concept_id", "va", "vb", "ia").distinct()
           .groupBy("concept_id", F.col("va").alias("variant_id_a"), F.col("vb").alias("variant_id_b")).agg(F.count("*").alias("shared")))
    ends = s.groupBy("concept_id", "variant_id").agg(F.min_by(F.struct("src", "st"), "i").alias("h"), F.max_by(F.struct("src", "st"), "i").alias("c"))
    p = _pairs(_variants(s).join(ends, ["concept_id", "variant_id"])).join(hit, ["concept_id", "variant_id_a", "variant_id_b"], "left")
    same = lambda k: (F.col(f"{k}_a.src") == F.col(f"{k}_b.src")) & (F.abs(F.col(f"{k}_a.st") - F.col(f"{k}_b.st")) < 1.0)
    return _verdict(p.withColumn("same_hook", same("h")).withColumn("same_close", same("c")), "shared_shots")


def _mean(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def frame_flat(px):
    """Dark or featureless frames identify no shot."""
    return let(_mean(px), lambda m: (m < 45) | (F.sqrt(F.aggregate(px, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(px)) < 12))


def _alike(x, y, limit=22):
    return (F.size(x) == F.size(y)) & (F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d) / F.size(x) < limit)


def _packed(px):
    """Greys as bytes, or as they are where one of them is no grey from 0 to 255; the other column is null."""
    fit = F.forall(px, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(fit, F.transform(px, lambda x: (x - 128).cast("tinyint"))).alias(f"{px}_b"), F.when(~fit, F.col(px)).alias(f"{px}_w")


def _unpacked(px):
    return F.coalesce(F.transform(f"{px}_b", lambda x: x.cast("int") + 128), F.col(f"{px}_w"))


def compare_seen(thumbs):
    """The same by what is seen: small grey frames that differ little. Frames whose mean grey is 22 or more apart can never be
    alike, so only the others are compared pixel by pixel. All frames are dealt out by concept once and written, each grey in a
    byte where all of a frame fit; what follows stays there."""
    t = written_by(thumbs.select("concept_id", "variant_id", "i", "dur", "narrated", *_packed("px")), "concept_id")
    t = t.withColumn("px", _unpacked("px")).drop("px_b", "px_w").withColumn("flat", frame_flat(F.col("px"))).withColumn("m", _mean(F.col("px")))
    w = Window.partitionBy("concept_id", "variant_id")
    use = t.withColumn("_all", F.min(F.col("flat").cast("int")).over(w) == 1).filter(~F.col("flat") | F.col("_all"))
    a = use.select("concept_id", F.col("variant_id").alias("va"), F.col("i").alias("ia"), F.col("px").alias("pa"), F.col("m").alias("ma"))
    b = use.select("concept_id", F.col("variant_id").alias("vb"), F.col("px").alias("pb"), F.col("m").alias("mb"))
    near = (F.col("va") < F.col("vb")) & (F.abs(F.col("ma") - F.col("mb")) < 22 + 1e-6)
    hit = (a.join(b, "concept_id").filter(F.when(near, _alike(F.col("pa"), F.col("pb")))).select("concept_id", "va", "vb", "ia").distinct()
           .groupBy("concept_id", F.col("va").alias("variant_id_a"), F.col("vb").alias("variant_id_b")).agg(F.count("*").alias("shared")))
    n = use.groupBy("concept_id", "variant_id").agg(F.count("*").alias("n"))
    v = t.groupBy("concept_id", "variant_id").agg(exact_sum("dur", 6).alias("len"), F.max("narrated").alias("voiced"), F.min_by("px", "i").alias("h"), F.max_by("px", "i").alias("c")).join(n, ["concept_id", "variant_id"])
    p = _pairs(v).join(hit, ["concept_id", "variant_id_a", "variant_id_b"], "left")
    return _verdict(p.withColumn("same_hook", _alike(F.col("h_a"), F.col("h_b"))).withColumn("same_close", _alike(F.col("c_a"), F.col("c_b"))), "shared_shots")
