import types

import pytest

from tallyglass.session import ensure_checkpoint_dir


def session(master, folder=None):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default: folder))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session("spark://host:7077"))


def test_the_named_folder_is_used():
    assert ensure_checkpoint_dir(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
