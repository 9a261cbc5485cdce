"""Checkpoint folder rules: the session's spark.checkpoint.dir first; a scratch folder only in
local mode; a cluster without the setting is refused."""
import pytest

from matchsmith.session import ensure_checkpoint_dir


class _Conf(dict):
    def get(self, k, default=None):
        return dict.get(self, k, default)


class _SC:
    def __init__(self, master, conf=None):
        self.master = master
        self._dir = None
        self._conf = _Conf(conf or {})

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d

    def getConf(self):
        return self._conf


class _Spark:
    def __init__(self, master, conf=None):
        self.sparkContext = _SC(master)
        self.conf = _Conf(conf or {})


def test_uses_configured_shared_folder():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_local_fallback_and_cluster_refusal():
    local = _Spark("local[4]")
    d = ensure_checkpoint_dir(local)
    assert d and d.startswith("/tmp") or "matchsmith-ckpt-" in d
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("spark://host:7077"))


def test_materialized_tables_can_be_released(spark):
    import os
    from matchsmith.session import materialize, release_materialized, session_memo
    table = session_memo(spark, ("released",), lambda: materialize(spark.range(5)))
    path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert table.count() == 5 and os.path.exists(path)
    release_materialized(spark)
    assert not os.path.exists(path)
    assert session_memo(spark, ("released",), lambda: materialize(spark.range(7))).count() == 7
