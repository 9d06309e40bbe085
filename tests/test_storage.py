"""Intermediate tables go to shared storage or not at all."""

from __future__ import annotations

import pytest

from shoplens import session
from shoplens.plans import cache


class FakeConf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeSession:
    def __init__(self, master, folder=None):
        class Context:
            def getCheckpointDir(self):
                return self.dir

            def setCheckpointDir(self, folder):
                self.dir = folder
        Context.master, Context.dir = master, None
        self.sparkContext = Context()
        self.conf = FakeConf({"spark.checkpoint.dir": folder} if folder else {})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://h"])
def test_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(FakeSession(master))
    assert session.checkpoint_dir(FakeSession(master, "hdfs://x/ckpt")) == "hdfs://x/ckpt"


def test_local_session_gets_one_scratch_folder():
    s = FakeSession("local[4]")
    assert session.checkpoint_dir(s) == session.checkpoint_dir(s)


def test_missing_rows_are_an_error(spark):
    with pytest.raises(RuntimeError, match="shared"):
        cache._check_rows(5, 0, "/x")
    assert cache.materialize(spark.range(7).toDF("id"), "storage_test").count() == 7
