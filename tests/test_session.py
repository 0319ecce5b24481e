import pytest

from sievecraft.session import shared_path


class FakeConf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


class FakeSession:
    def __init__(self, **values):
        self.conf = FakeConf(**values)


def test_the_clusters_folder_is_used():
    s = FakeSession(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    a, b = shared_path(s, "x"), shared_path(s, "x")
    assert a.startswith("hdfs:///shared/x-") and a != b


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_path(FakeSession(spark_master="yarn"), "x")


def test_local_mode_falls_back_to_one_temporary_folder():
    s = FakeSession(spark_master="local[2]", spark_app_id="a")
    assert shared_path(s, "x").rsplit("/", 1)[0] == shared_path(s, "y").rsplit("/", 1)[0]
