from types import SimpleNamespace

import pytest

from clicktide.session import is_local, scratch_dir


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d),
        sparkContext=SimpleNamespace(master=master),
    )


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://h"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(master), "x")
    assert scratch_dir(session(master, "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")


def test_a_local_master_does_without():
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[1,1,512]")
    assert "/x-" in scratch_dir(session("local[2]"), "x")
