"""Queries that meet a derived table many times work it out once."""
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("key", ["GT-11", "JN-07"])
def test_lineitem_is_not_read_again(spark, key):
    """What is left to do when the query is returned reads written tables instead of the lines, joined and numbered anew each time."""
    left = entry.queries()[key](spark, "/root/testdata/sf0.001").inputFiles()
    assert left and not any("lineitem" in f for f in left)
