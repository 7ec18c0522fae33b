"""What a task holds follows neither the input nor a number that suited a smaller one."""
from framelake import registry as R


def test_partitions_follow_the_input(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        R.follow_input(spark, R.ROWS_EACH * int(before))
        assert spark.conf.get(name) == before
        R.follow_input(spark, R.ROWS_EACH * 300 + 1)
        assert spark.conf.get(name) == "301"
        R.follow_input(spark, 10)
        assert spark.conf.get(name) == "301"
    finally:
        spark.conf.set(name, before)
