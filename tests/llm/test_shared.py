"""The folder that driver and executors share."""

import os
from types import SimpleNamespace

import pytest

from heaplens.llm.common import shared_dir


def session(master, **conf):
    get = lambda key, default=None: conf.get(key.replace(".", "_"), default)
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get), master=master, applicationId=f"app-{master}"))


def test_shared_dir():
    """The session's setting counts; without one a local session keeps one folder of its own, and a cluster is an error. No setting is changed."""
    assert shared_dir(session("spark://x:7077", spark_checkpoint_dir="hdfs:///c/")) == "hdfs:///c"
    own = session("local[2]")
    folder = shared_dir(own)
    assert folder.startswith("file://") and os.path.isdir(folder.removeprefix("file://")) and shared_dir(own) == folder != shared_dir(session("local[3]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
