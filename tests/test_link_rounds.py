"""Rounds of average link that are dealt out over tasks, stay in one task, or change between the two."""
import numpy as np
import pytest

from framelake.plans import similarity as S

from test_faces import faces, frame, greedy


@pytest.mark.parametrize("alone_bytes, alone_work", [(0, 0), (1 << 20, 9_000), (1 << 20, 1 << 30)])
def test_every_way_gives_the_same_groups(spark, monkeypatch, alone_bytes, alone_work):
    for name, value in {"ALONE_BYTES": alone_bytes, "ALONE_WORK": alone_work, "SCAN": 13}.items():
        monkeypatch.setattr(S, name, value)
    v = faces(60, 5, 4, noise=0.6)
    got = {r.key: r.cluster for r in S.average_link(frame(spark, v), 0.363).collect()}
    assert got == greedy(v, 0.363)


def test_keys_may_be_texts(spark):
    v = faces(40, 4, 2, noise=0.6)
    e = frame(spark, v).selectExpr("cast(g as string) AS g", "format_string('k%03d', key) AS key", "vec")
    got = {int(r.key[1:]): int(r.cluster[1:]) for r in S.average_link(e, 0.363).collect()}
    assert got == greedy(v, 0.363)


def test_pairs_are_not_written(spark, monkeypatch):
    """The pairs of alike faces are as many as the square of a person's pictures: no table holds more rows than there are faces."""
    rows, once = [], S.written_once
    monkeypatch.setattr(S, "written_once", lambda df: rows.append(once(df)) or rows[-1])
    v = faces(90, 2, 5, noise=0.3)
    S.average_link(frame(spark, v), 0.363).collect()
    assert ((v @ v.T) > 0.363).sum() > 3000 and max(t.count() for t in rows) <= 90
