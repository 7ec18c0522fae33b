"""Values that lie on a limit."""
import itertools

import pytest

from framelake.operators import gate as G


@pytest.mark.parametrize("lengths, status", [([3.0, 1.3, 1.3, 2.1, 1.9, 2.4], "warn"), ([2.4, 3.2, 3.9, 2.4, 2.5, 1.6, 1.4, 2.6], "pass")])
def test_pace_on_the_limit(spark, lengths, status):
    """A variation of 0.3 but for the last bit: decided in the order of the shots, whatever order the rows come in."""
    videos, rows = [], []
    for v, order in enumerate(itertools.islice(itertools.permutations(range(len(lengths))), 0, 720, 90)):
        rows += [(v, i, float(i), lengths[i]) for i in order]
        videos.append((v, 20.0))
    shots = spark.createDataFrame(rows, "video_id int, i int, t0 double, dur double")
    got = G.gt_pace(spark.createDataFrame(videos, "video_id int, picture_s double"), shots).filter("check = 'pace_curve'").collect()
    assert len(got) == 8 and {r.status for r in got} == {status}
