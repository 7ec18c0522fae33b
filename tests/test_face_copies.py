"""Copies of face vectors."""
import numpy as np

from framelake.plans import similarity as S

from test_faces import faces, greedy


def test_copies_start_as_one_group(spark, monkeypatch):
    """Equal vectors meet others once, however many there are; groups are those of merging the best pair each time. Zero
    vectors are like nothing, not even each other."""
    one = faces(24, 5, 3, noise=0.6)
    v = np.concatenate([one, one, one[:7], one[:2], np.zeros((2, one.shape[1]))])
    v = v[np.random.default_rng(1).permutation(len(v))]
    met, pairs = [], S.cosine_pairs
    monkeypatch.setattr(S, "cosine_pairs", lambda e, t: met.append(e.count()) or pairs(e, t))
    e = spark.createDataFrame([(0, i, w.tolist()) for i, w in enumerate(v)], "g int, key long, vec array<double>").repartition(3)
    got = {r.key: r.cluster for r in S.average_link(e, 0.363).collect()}
    assert met == [26] and got == greedy(v, 0.363)
