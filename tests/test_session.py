"""Checkpoint folder policy: shared folder from the cluster, local fallback only in local mode."""

import pytest

from meterkit import session


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, path):
        self._ckpt = path


class _Session:
    def __init__(self, master, conf=None):
        self.conf, self.sparkContext = _Conf(conf or {}), _Context(master)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="shared storage"):
        session.checkpoint_dir(_Session("yarn"))


def test_cluster_folder_is_used_as_is():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/ckpt"})
    assert session.checkpoint_dir(s) == "hdfs://nn/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs://nn/ckpt"
    assert session.scratch_path(s, "x") == "hdfs://nn/ckpt/x"


def test_local_mode_falls_back_to_scratch():
    s = _Session("local[2]")
    path = session.checkpoint_dir(s)
    assert path and s.conf.get("spark.checkpoint.dir") == path
