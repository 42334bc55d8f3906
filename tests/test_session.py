"""Session helpers respect settings the cluster already made."""

from passagekit.session import DEFAULTS, checkpoint_dir, tune


def test_tune_only_fills_unset(spark):
    key = "spark.sql.adaptive.skewJoin.skewedPartitionFactor"
    spark.conf.set(key, "9")
    try:
        tune(spark)
        assert spark.conf.get(key) == "9"
    finally:
        spark.conf.set(key, DEFAULTS[key])


def test_checkpoint_dir_uses_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if configured:
        assert d == configured              # the cluster's shared folder wins
    assert spark.sparkContext.getCheckpointDir() is not None


def test_checkpoint_dir_is_required_on_a_cluster():
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
