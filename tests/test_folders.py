"""Where intermediate tables go."""

import pytest

from awardgrid.operators.matching import shared_folder


class Session:
    """As much of a session as the folder is told from."""

    def __init__(self, master, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self.sparkContext = self
        self.master = master

    def getConf(self):
        return Session(self.master)

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder():
    assert shared_folder(Session("local[4]")).startswith("file:///")
    assert shared_folder(Session("spark://x:1", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert shared_folder(Session("spark://x:1", spark_sql_warehouse_dir="s3a://a/w")) == "s3a://a/w/_scratch"
    for own in ("file:/tmp/spark-warehouse", "/tmp/w", "spark-warehouse"):
        with pytest.raises(ValueError):
            shared_folder(Session("local-cluster[2,1,1024]", spark_sql_warehouse_dir=own))
