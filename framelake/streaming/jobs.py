"""Streaming forms of batch rules. Sources are file streams; sinks are append files or a keyed table
merged per micro-batch. Every job can be restarted from its checkpoint; merges are idempotent."""
import uuid

from pyspark.sql import functions as F

from framelake.operators import posts as P, rules as R
from framelake.session import checkpoint_dir


def file_stream(spark, path, per_trigger=None):
    """A stream over parquet files; the schema is taken from what is there, never inferred per batch."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def work_dir(spark):
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(df, path=None):
    """Runs an append stream over everything available and returns what it wrote."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def drain_latest(rows, keys, order, path=None):
    """Runs a stream into the newest row per key. Spark's state store holds that row and is the result: it is read back by the
    state data source, so a read costs one row per key, however many batches ever ran. A restart on the same path goes on
    from there."""
    spark = rows.sparkSession
    path = path or work_dir(spark)
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    newest.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").load(f"{path}/ckpt")
    best = state.schema["value"].dataType.fields[0].name           # what max_by keeps: the row, then its order
    return state.select("key.*", F.col("value")[best].alias("_r")).select(*keys, "_r.*")


# ---- jobs ------------------------------------------------------------------------------------
def unit_state(updates, artifacts=None, path=None):
    """Latest state per work unit. Disk wins: done needs an artifact, and an artifact means done."""
    s = drain_latest(updates, ["unit"], ["updated_at", "seq"], path)
    if artifacts is None:
        return s
    a = artifacts.select("unit").distinct().withColumn("_a", F.lit(True))
    return (s.join(a, "unit", "left").withColumn("state", F.when(F.col("_a"), "done").when(F.col("state") == "done", "pending").otherwise(F.col("state"))).drop("_a"))


def stalled(updates, quiet="2 minutes", delay="10 minutes"):
    """A unit that was silent for the quiet time without being done: its session window has closed."""
    w = (updates.withWatermark("updated_at", delay).groupBy("unit", F.session_window("updated_at", quiet))
         .agg(F.max_by("state", F.struct("updated_at", "seq")).alias("state"), F.max("updated_at").alias("last_update"), F.count("*").alias("updates")))
    return w.filter("state <> 'done'").select("unit", "state", "last_update", "updates")


def stream_sessions(media, gap_min=90, delay="1 hour"):
    w = media.withWatermark("date", delay).groupBy("library_id", F.session_window("date", f"{gap_min} minutes"))
    return (w.agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.count_if(F.col("type") == "photo").alias("photos"), F.count_if("favorite").alias("favorites"))
            .select("library_id", "start", "end", "n", "photos", "favorites"))


def stream_results(results, path=None):
    """Measurements arriving over time; the newest value per post and metric, one row per post."""
    m = drain_latest(results, ["id", "metric"], ["at", "seq"], path)
    return m.groupBy("id").pivot("metric", ["views", "saves", "likes"]).agg(F.max("value"))


def ingest_batches(batches, path=None, time=None, remember="400 days"):
    """A batch already covered is not taken again: the first row of a batch to arrive is kept. With an event time, a batch is
    remembered for as long as stated, which bounds the state; without one, for good."""
    if time is None:
        return drain(batches.dropDuplicates(["batch"]), path)
    return drain(batches.withWatermark(time, remember).dropDuplicatesWithinWatermark(["batch"]), path)


def stream_contradictions(lines, facts):
    """Arriving lines against the recorded facts: a stateless join with a static side."""
    return R.contradictions(lines, facts)


def stream_scores(posts, base, window="7 days", delay="1 day"):
    """Mean post score per platform and window, against the baseline of past posts."""
    s = P.score_posts(posts, ("platform",), base).filter("score is not null")
    return (s.withWatermark("published", delay).groupBy("platform", F.window("published", window))
            .agg(F.avg("score").alias("score"), F.count("*").alias("posts")).select("platform", F.col("window.start").alias("start"), "score", "posts"))
