"""Batch files that a query writes for itself."""
import __spark_entry__ as entry


def test_batches_are_written_compressed(spark):
    """Plain JSON repeats its names for each item: nine times the bytes."""
    files = entry.queries()["SRC-03"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
