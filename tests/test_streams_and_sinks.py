"""Streams over several files, restarts, and the all-or-nothing sink."""
import datetime as dt

from pyspark.sql import functions as F

from framelake.sources import readers as R, sinks as S
from framelake.streaming import jobs as J


def ts(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_write_is_whole_or_old(spark, tmp_path):
    p = str(tmp_path / "t")
    S.write_table(spark.range(5).toDF("id"), p)
    bad = spark.range(5).select(F.expr("if(id = 3, raise_error('boom'), id)").cast("long").alias("id"))
    try:
        S.write_table(bad, p)
        raise AssertionError("should fail")
    except Exception as e:
        assert "boom" in str(e)
    assert S.read_table(spark, p).count() == 5
    S.write_table(spark.range(7).toDF("id"), p)
    assert S.read_table(spark, p).count() == 7


def test_unit_state_survives_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sch = "unit int, state string, updated_at timestamp, seq long"
    put(spark, src, [(1, "running", ts(0), 1), (2, "done", ts(1), 2)], sch)
    art = spark.createDataFrame([(3,)], "unit int")
    first = {r.unit: r.state for r in J.unit_state(J.file_stream(spark, src, 1), art, out).collect()}
    assert first == {1: "running", 2: "pending"}          # done without an artifact is not done
    put(spark, src, [(1, "failed", ts(9), 3), (2, "running", ts(0), 4), (3, "running", ts(2), 5)], sch)
    again = {r.unit: r.state for r in J.unit_state(J.file_stream(spark, src, 1), art, out).collect()}
    assert again == {1: "failed", 2: "pending", 3: "done"}


def test_batches_are_taken_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", 1), ("a", 1), ("b", 2)], "batch string, n int")
    assert J.ingest_batches(J.file_stream(spark, src, 1), out).count() == 2
    put(spark, src, [("a", 9), ("c", 3)], "batch string, n int")
    got = {r.batch: r.n for r in J.ingest_batches(J.file_stream(spark, src, 1), out).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_stalled_and_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [(1, "running", ts(0), 1), (1, "running", ts(1), 2), (2, "done", ts(0), 3), (1, "running", ts(60), 4)], "unit int, state string, updated_at timestamp, seq long")
    got = [(r.unit, r.updates) for r in J.drain(J.stalled(J.file_stream(spark, src)), str(tmp_path / "o1")).collect()]
    assert got == [(1, 2)]
    m = str(tmp_path / "media")
    put(spark, m, [(1, ts(0), "photo", True), (1, ts(90), "video", False), (1, ts(181), "photo", False), (1, ts(900), "photo", False)], "library_id int, date timestamp, type string, favorite boolean")
    got = sorted(r.n for r in J.drain(J.stream_sessions(J.file_stream(spark, m)), str(tmp_path / "o2")).collect())
    assert got == [1, 2]          # 90 minutes apart stay together; the last session is still open


def test_scan_and_batches(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for n in ("a.JPG", "sub/b.mov", "sub/.hidden.jpg", "c.txt", "x.insv"):
        (tmp_path / "d" / n).write_bytes(b"12345")
    got = {r.kind: r.n for r in R.classify_listing(R.scan_media(spark, str(tmp_path / "d"))).collect()}
    assert got == {"photo": 1, "video": 1, "skipped": 1, "360": 1}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "catalog-1.json").write_text('{"items": [{"id": "a", "quality": 4}, {"id": "b"}]}')
    (tmp_path / "c" / "catalog-2.json").write_text('[{"id": "c", "start_s": 1.5}]')
    got = sorted((r.origin, r.id) for r in R.read_batches(spark, str(tmp_path / "c" / "*.json")).collect())
    assert got == [("catalog-1", "a"), ("catalog-1", "b"), ("catalog-2", "c")]


def test_two_writers_lose_no_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    p = str(tmp_path / "swapped")
    S.write_table(spark.range(1).toDF("id"), p)
    # a writer that read number 1 while another one made number 2 is refused
    late = S._written(spark.range(9).toDF("id"), p, ())
    S.update_table(spark, p, lambda t: t.unionAll(spark.createDataFrame([(10,)], "id long")))
    assert not S.swap(spark, p, late, 1) and {r.id for r in S.read_table(spark, p).collect()} == {0, 10}
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda k: S.update_table(spark, p, lambda t: t.unionAll(spark.createDataFrame([(k,)], "id long"))), (20, 30)))
    assert sorted(done) == [3, 4] and {r.id for r in S.read_table(spark, p).collect()} == {0, 10, 20, 30}
    assert {r.id for r in S.read_table(spark, p, 2).collect()} == {0, 10}
