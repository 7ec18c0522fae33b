"""All-or-nothing table writes: a new version is written whole, then becomes the next number if no one else took it."""
import uuid

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _numbers(spark, path):
    """Numbers of all versions that ever were the table, rising."""
    fs, jvm = _fs(spark, path)
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())


def _version(spark, path, number):
    fs, jvm = _fs(spark, path)
    f = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{number}"))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def swap(spark, path, version, expected):
    """Makes a written version the table if `expected` (0: none yet) is still its number: the pointer of the next number is moved into
    place by a rename that never overwrites. False if another writer was first; nothing has changed then."""
    fs, jvm = _fs(spark, path)
    P = jvm.org.apache.hadoop.fs.Path
    tmp, to = P(f"{path}/_versions/.{version}"), P(f"{path}/_versions/{expected + 1}")
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(tmp), fs.makeQualified(to), never)
    except (Py4JJavaError, PySparkException):
        fs.delete(tmp, False)
        if not fs.exists(to):
            raise
        return False
    return True


def _written(df, path, partition_by):
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{path}/{version}")
    return version


def write_table(df, path, partition_by=()):
    """Writes <path>/v-<id> and makes it the table, whatever the table is now. Readers see the old version until the switch; a failed
    write leaves it untouched; versions of other writers keep their numbers."""
    version = _written(df, path, partition_by)
    while not swap(df.sparkSession, path, version, (_numbers(df.sparkSession, path) or [0])[-1]):
        pass
    return version


def update_table(spark, path, change, partition_by=()):
    """Replaces the table by change(table). If another writer was first, the change is worked out again on what that one left, so no
    update is lost. Returns the number of the new version."""
    while True:
        number = _numbers(spark, path)[-1]
        version = _written(change(spark.read.parquet(f"{path}/{_version(spark, path, number)}")), path, partition_by)
        if swap(spark, path, version, number):
            return number + 1


def current(spark, path):
    """Name of the version that is the table now; None before the first write."""
    numbers = _numbers(spark, path)
    return _version(spark, path, numbers[-1]) if numbers else None


def read_table(spark, path, number=None):
    """The table as of now, or as of a version number."""
    return spark.read.parquet(f"{path}/{current(spark, path) if number is None else _version(spark, path, number)}")
