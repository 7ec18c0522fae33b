"""How the near-duplicate stage finds its candidates, and what its workers keep."""
import pyarrow as pa

import corpus_pipeline as C
from framelake.llm import common, simhash as S


def test_stage_searches_by_simhash(spark, sf, monkeypatch):
    seen = []
    search = S.near_edges
    monkeypatch.setattr(S, "near_edges", lambda fps, tau, wide=None: seen.append((fps.count(), tau)) or search(fps, tau, wide))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    kept = C.near_duplicates(spark, docs, sf).count()
    assert 0 < kept <= 60 and seen and seen[0][0] > 0 and seen[0][1] == S.MAX_BITS


def test_fingerprint_is_the_simhash_of_its_shingles():
    text = "one two three four five six seven one two three four five"
    assert S.simhash(S.shingles(text, 5)) == S.fingerprint(text, 5)


def test_batches_pass_a_worker_that_gives_back():
    batches = [pa.RecordBatch.from_pydict({"a": [1, 2]}), pa.RecordBatch.from_pydict({"a": [3]})]
    assert list(common.gives_back(lambda bs: (b for b in bs))(iter(batches))) == batches


def test_every_stage_bounds_its_batches(spark, sf):
    """Stages are also run one by one, without run()."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in C.STAGES:
        own = spark.newSession()
        own.conf.unset(name)
        stage(own, own.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
        assert own.conf.get(name) == str(common.BATCH_BYTES)
