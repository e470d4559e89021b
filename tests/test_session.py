import pytest

from lakesteward import session


class Context:
    def __init__(self, master, conf):
        self.master, self.conf, self.applicationId, self.dir = master, conf, "app", None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, master, conf):
        self.sparkContext = Context(master, conf)
        self.conf = conf


def test_shared_folder_comes_from_the_session(spark):
    assert session.workspace(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert session.workspace(spark, "x") != session.workspace(spark, "x")


def test_no_machine_local_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session("spark://host:7077", Conf()))
    assert session.shared_root(Session("yarn", Conf({"spark.checkpoint.dir": "hdfs:///shared"}))) == "hdfs:///shared"
