"""Tables that cut a lineage leave no shuffle files behind."""
import time

from framelake.plans import similarity as S


def files(spark):
    return set(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))


def shuffled(spark, write):
    df = spark.range(20_000).selectExpr("id % 1000 AS k", "id AS v").repartition(4, "k").groupBy("v").count()
    before = files(spark)
    table = write(df)
    for _ in range(20):
        left = [f for f in files(spark) - before if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.5)
    assert table.count() == 20_000
    return left


def test_no_shuffle_file_outlives_what_is_written(spark):
    assert shuffled(spark, S.written_once) == []
    assert shuffled(spark, lambda df: S.written_by(df, "v")) == []


def test_results_keep_theirs(spark):
    """The setting is the session's own again: a result may be read twice."""
    S.written_once(spark.range(10).groupBy("id").count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    df = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    assert df.collect() == df.collect() and len(df.collect()) == 7
