"""Variants compared by what is seen."""
import itertools

import numpy as np

from framelake.operators import people as P


def test_frames_are_dealt_out_once(spark):
    """Shared frames by brute force; the pixels of a concept travel once and no frame is repeated for its neighbours in grey."""
    r = np.random.default_rng(3)
    shots = {(v // 3, v, i): r.integers(40, 120, 32) if r.random() < 0.5 else np.clip(r.integers(0, 3) * 60 + 50 + r.integers(-30, 31, 32), 0, 255) for v in range(12) for i in range(4)}
    t = spark.createDataFrame([(c, v, i, 1.0, False, [int(x) for x in px]) for (c, v, i), px in shots.items()], "concept_id long, variant_id long, i int, dur double, narrated boolean, px array<int>")
    out = P.compare_seen(t)
    got = {(x.a, x.b): x.shared_shots for x in out.collect()}
    flat = lambda px: px.mean() < 45 or px.std() < 12
    seen = {}
    for (c, v, i), px in shots.items():
        seen.setdefault((c, v), []).append(px)
    seen = {k: [px for px in own if not flat(px)] or own for k, own in seen.items()}
    want = {}
    for (p, own), (q, other) in itertools.combinations(sorted(seen.items()), 2):
        if p[0] == q[0]:
            want[(p[1], q[1])] = sum(any(np.abs(x - y).mean() < 22 for y in other) for x in own) / max(1, min(len(own), len(other)))
    assert got == want and len(set(want.values())) > 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
