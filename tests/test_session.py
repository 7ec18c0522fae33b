"""Where intermediate tables may lie."""
import pytest

from framelake.session import checkpoint_dir


class Fake:
    def __init__(self, master, folder=None):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

    def get(self, key, default=None):
        return self.folder

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, d):
        self.folder = d


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        checkpoint_dir(Fake("spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_dir(Fake("local-cluster[2,1,1024]"))
    assert checkpoint_dir(Fake("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert checkpoint_dir(Fake("local[2]")).startswith("/")
