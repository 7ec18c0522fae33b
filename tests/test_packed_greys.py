"""Frames travel as bytes, once, and come back as they were."""
import itertools

import numpy as np

from framelake.operators import people as P


def test_greys_that_fit_no_byte_are_kept(spark):
    rows = [([0, 255, 128],), ([256, 0, 1],), ([-1, 0, 1],), ([5, None, 6],), ([],), (None,)]
    t = spark.createDataFrame(rows, "px array<int>")
    back = t.select("px", *P._packed("px")).withColumn("again", P._unpacked("px")).collect()
    assert [r.again for r in back] == [r[0] for r in rows]
    assert [r.px_b is not None for r in back] == [True, False, False, False, True, False]


def test_frames_are_read_once(spark):
    r = np.random.default_rng(5)
    shots = {(v // 3, v, i): r.integers(0, 2) * 90 + r.integers(60, 300, 32) for v in range(9) for i in range(3)}
    t = spark.createDataFrame([(c, v, i, 1.0, False, [int(x) for x in px]) for (c, v, i), px in shots.items()], "concept_id long, variant_id long, i int, dur double, narrated boolean, px array<int>")
    out = P.compare_seen(t)
    got = {(x.a, x.b): x.shared_shots for x in out.collect()}
    for (a, b), share in got.items():
        one, two = ([px for (_, v, _), px in shots.items() if v == k] for k in (a, b))
        assert share == sum(any(np.abs(x - y).mean() < 22 for y in two) for x in one) / 3
    assert len(got) == len([1 for a, b in itertools.combinations(range(9), 2) if a // 3 == b // 3])
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
