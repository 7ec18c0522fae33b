"""Helpers that several corpus operators share."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.session import checkpoint_dir, delete_at_exit


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs only a reread. It goes when the
    application ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowest_hashed(df: DataFrame, group: str, key: str, k: int, groups: int) -> DataFrame:
    """Up to k rows of each of the `groups` largest groups: those whose key has the lowest hash. Counts come first, so that
    all but about 2 k rows of a group are dropped where they are read, however large the group is."""
    counts = df.groupBy(group).agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), group).limit(groups)
    low = F.lit(-2.0 ** 63) + F.lit(2.0 ** 65) * k / F.col("_all")      # 2 k of _all hash values are expected below
    some = df.withColumn("_h", F.xxhash64(key)).join(F.broadcast(counts), group).where(F.col("_h").cast("double") <= low)
    return (some.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).where(F.col("_k") <= k)
            .drop("_h", "_k", "_all"))


def components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", root: str = "component") -> DataFrame:
    """Connected components of an edge list: one row per node that has an edge, with the smallest node it reaches.

    Alternating large-star and small-star rounds: each node's neighbours are joined to its smallest one, so no pairs
    within a component are built and the edges never grow. A round is two aggregations whose partial sums bound what a
    node with very many links sends; each round's edges are written to the shared folder. Rounds end when no edge
    changes (a count and a sum over all edges, computed by Spark)."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    e = written(e, "edges")
    before, parts = None, partitions(e.sparkSession)

    def to_lowest(rows, low, n):
        """rows(u, w) with m of their u. Of few edges, few nodes can hold more than one in 2 P of n, and those are looked up where
        the edges are read, so that no hub is one task's work."""
        hubs = low.where(F.col("c") * 2 * parts > n).select("u", F.col("m").alias("hub"))       # at most 4 P: degrees add up to 2 n
        found = rows.join(F.broadcast(hubs), "u", "left")
        rest = found.where("hub IS NULL").drop("hub").join(low.select("u", "m"), "u")
        return found.where("hub IS NOT NULL").select("u", "w", F.col("hub").alias("m")).unionAll(rest.select("u", "w", "m"))

    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = e.count() if before is None else before[0]
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        # large star: neighbours above u go to the smallest of u's surroundings
        e1 = to_lowest(e.select(F.col("v").alias("u"), F.col("u").alias("w")), low, n).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours go to the smallest of them
        low1 = e1.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        e2 = (to_lowest(e1.select("u", F.col("v").alias("w")), low1, n).select("u", F.col("w").alias("v"), "m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
              .unionAll(low1.select("u", F.col("m").alias("v"))).distinct())
        e = written(e2, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (e.groupBy("u").agg(F.min("v").alias("m"))
            .unionAll(e.groupBy("v").agg(F.min("v").alias("m")))
            .groupBy(F.col("u").alias(node)).agg(F.min("m").alias(root)))


#: Bytes of texts that reach a Python worker at once.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most BATCH_BYTES instead of 10,000 rows of any length, so the memory of
    an executor does not follow the length of the texts. A session that has set its own bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def gives_back(run: Callable) -> Callable:
    """A function for mapInArrow whose Python worker returns its freed memory to the system at a task's end. Workers live on for
    later stages, and what their allocators keep would count against the executor until then."""
    def with_return(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # of the GNU C library
        if trim is not None:
            trim(0)
    return with_return
