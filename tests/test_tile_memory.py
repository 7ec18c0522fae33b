"""Tiles of vectors in a Python worker."""
import tracemalloc

import numpy as np
import pyarrow as pa

from framelake.plans import similarity as S


def test_tile_is_read_without_python_objects():
    """The vectors of a tile cost little more than their numbers, and a slice of a batch gives its own rows."""
    v = np.random.default_rng(1).normal(size=(512, 64))
    tile = lambda m: [{"k": i, "v": r.tolist()} for i, r in enumerate(m)]
    rows = pa.array([tile(v[:256]), tile(v[256:])], pa.list_(pa.struct([("k", pa.int64()), ("v", pa.list_(pa.float64()))])))[1:]
    tracemalloc.start()
    got = S._matrix(rows[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, v[256:]) and peak < 3 * got.nbytes


def test_text_keys_and_tied_tiles(spark):
    """Pairs of a tile with itself and with others, with text keys."""
    v = np.random.default_rng(2).normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    rows = [("g", f"k{i:02d}", w.tolist()) for i, w in enumerate(v)]
    got = {(r.a, r.b) for r in S.cosine_pairs(spark.createDataFrame(rows, "g string, key string, vec array<double>"), 0.4, tile=16).collect()}
    assert got == {(f"k{i:02d}", f"k{j:02d}") for i in range(60) for j in range(i + 1, 60) if s[i, j] > 0.4}
