import pytest

from flowspark.session import shared_root, stable_dir, work_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(values)


def test_shared_root_prefers_the_session_setting():
    s = _Session(**{"spark.checkpoint.dir": "hdfs://shared/ckpt", "spark.master": "yarn"})
    assert shared_root(s) == "hdfs://shared/ckpt"
    assert stable_dir(s, "checkpoints", "f", "st") == "hdfs://shared/ckpt/flowspark/checkpoints/f/st"
    assert work_dir(s, "x") != work_dir(s, "x")  # a fresh folder per call


def test_local_session_without_setting_gets_one_stable_folder():
    s = _Session(**{"spark.master": "local[4]", "spark.app.id": "app-test-1"})
    assert shared_root(s) == shared_root(s)


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError):
        shared_root(_Session(**{"spark.master": "yarn"}))
