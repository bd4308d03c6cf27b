"""Shared-folder rules: use the configured checkpoint folder; clean only this app's subfolder."""

import os

from pathweave.session import checkpoint_dir, cleanup_shared, shared_path


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    assert configured is None or d == configured
    assert checkpoint_dir(spark) == d                      # stable, never replaced
    p = shared_path(spark, "x")
    assert p.startswith(d) and spark.sparkContext.applicationId in p


def test_cleanup_removes_only_this_application(spark, tmp_path):
    d = checkpoint_dir(spark)
    other = os.path.join(d, "someone-else-keep-me")
    os.makedirs(other, exist_ok=True)
    p = shared_path(spark, "probe")
    spark.range(3).write.mode("overwrite").parquet(p)
    assert os.path.exists(p.replace("file:", ""))
    cleanup_shared(spark)
    assert not os.path.exists(p.replace("file:", "")) and os.path.isdir(other)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from pathweave import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://head:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
