"""The gate hands on what its checks found, not what they dealt out to find it."""
import __spark_entry__ as entry


def exchanges(spark, key):
    return entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_checks_are_not_all_held_by_the_roll_up(spark):
    """20 exchanges of lines, samples and words met in one plan, with all their files on disk at once."""
    assert exchanges(spark, "GT-16") <= 4


def test_weak_lines_are_counted_before_the_verdict(spark):
    assert exchanges(spark, "GT-06") <= 1
