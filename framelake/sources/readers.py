"""Readers for media folders, catalogue batches, timelines, scripts and nested text."""
from pyspark.sql import functions as F

from framelake.operators.library import media_kind


def scan_media(spark, root, recursive=True):
    """Listing of a folder tree. Only path, length and time are selected, so no content is read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return r.load(root).select("path", "length", "modificationTime")


def classify_listing(listing, g=()):
    """Counts and bytes per kind; dotfiles are left out, other extensions counted as skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    return (listing.withColumn("_name", name).filter(~F.col("_name").startswith("."))
            .withColumn("kind", F.coalesce(media_kind("_name"), F.lit("skipped")))
            .groupBy(*g, "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))


# Every field of a catalogue item; what a file does not have is null.
ITEM_SCHEMA = ("struct<id:string,path:string,type:string,date:string,place:string,start_s:double,end_s:double,duration_s:double,fps:double,description:string,quality:int,"
               "obstructions:array<string>,hook:int,subject_present:boolean,favorite:boolean,audio:string,framing:string,focus:struct<x:double,y:double>,"
               "direction:struct<yaw:double,pitch:double,fov:double>,sheet:string,tags:array<string>,notes:string,use:boolean,reason:string,"
               "live:struct<available:boolean,uuid:string,library_mov:string,mov:string,start_s:double,end_s:double,still_s:double,motion:string,usable:boolean,why:string>,"
               "human:struct<emotion:string,reaction:boolean,candid:boolean,real_voice:string,story_potential:int,story_ids:array<string>>,burst:string>")
BATCH_SCHEMA = f"struct<batch:string,agent:string,generated:string,summary:string,struck_me:array<string>,gaps:array<string>,items:array<{ITEM_SCHEMA}>>"


def parse_batches(files, origin=None):
    """files(file, body): JSON that is a list of items or a batch that holds them under `items`. One row per item."""
    body = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{ITEM_SCHEMA}>")).otherwise(F.from_json("body", BATCH_SCHEMA)["items"])
    name = F.regexp_replace("file", r"^.*/|\.json$", "") if origin is None else origin
    return files.withColumn("_i", F.explode(body)).select(name.alias("origin"), "_i.*")


def parse_batch_heads(files):
    """What a batch says about itself, one row per file that is a batch and not a bare list."""
    return files.filter(~F.ltrim("body").startswith("[")).withColumn("_b", F.from_json("body", BATCH_SCHEMA)).select("file", "_b.batch", "_b.agent", "_b.generated", "_b.summary", "_b.struck_me", "_b.gaps")


def read_batches(spark, path, origin=None):
    """Batch files of a catalogue, each item with the batch it came from (origin: a column over `file`, by default its name)."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    return parse_batches(raw, origin)


def read_packed_batches(spark, path, origin=None):
    """As read_batches, for catalogues of very many small batches: text files that hold a batch per line, its file name and its
    JSON on one line, a tab between. The number of files follows the bytes, not the number of batches."""
    line = F.split("value", "\t", 2)
    raw = spark.read.text(path).select(F.nullif(line[0], F.lit("")).alias("file"), line[1].alias("body"))
    return parse_batches(raw, origin)
