"""Moments that a sheet and the catalogue both read."""
import __spark_entry__ as entry


def test_moments_are_worked_out_once(spark):
    """The rows of a moment's line are numbered for the table that both read, and not again for each."""
    plan = entry.queries()["JN-10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" not in plan
