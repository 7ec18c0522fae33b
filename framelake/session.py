"""Session settings the operators rely on."""
import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app="framelake", cores="*", partitions=8, **conf):
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("FRAMELAKE_DRIVER_MEM", "16g")))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def checkpoint_dir(spark):
    """The shared folder for tables that cut a lineage, for derived tables and for stream state: spark.checkpoint.dir.
    Where it is unset, a local master gets a temporary folder for the application; a cluster is refused, since its
    executors would each write to a disk of their own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="framelake-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def delete_at_exit(spark, path):
    """An intermediate table goes when the application's JVM ends: results that read it are lazy until then."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
