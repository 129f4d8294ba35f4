import pytest

from leadflow.functions.workspace import shared_root, workspace


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    conf = _Conf()


def session(**conf):
    s = _Session()
    s.conf = _Conf(conf)
    return s


def test_named_folder_wins():
    s = session(**{"spark.checkpoint.dir": "hdfs://x/shared", "spark.sql.warehouse.dir": "file:/w", "spark.master": "yarn"})
    assert workspace(s, "t").startswith("hdfs://x/shared/t-")


@pytest.mark.parametrize("root", ["file:/w", "/w"])
def test_machine_local_warehouse_is_refused_on_a_cluster(root):
    with pytest.raises(ValueError):
        shared_root(session(**{"spark.sql.warehouse.dir": root, "spark.master": "yarn"}))
    assert shared_root(session(**{"spark.sql.warehouse.dir": root, "spark.master": "local[8]"})) == root


def test_shared_warehouse_is_taken():
    assert shared_root(session(**{"spark.sql.warehouse.dir": "s3a://b/w", "spark.master": "k8s://x"})) == "s3a://b/w"
