"""The checkpoint folder comes from the session; a fallback only when unset."""

from sessionscope.session import ensure_checkpoint_dir


def test_configured_checkpoint_dir_wins(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    got = ensure_checkpoint_dir(spark, fallback=str(tmp_path / "ignored"))
    assert got  # a folder is always named
    # an existing folder is never replaced by the fallback
    assert spark.sparkContext.getCheckpointDir() == before
    assert not (tmp_path / "ignored").exists()


def test_checkpoint_cuts_lineage(spark):
    from sessionscope.plans.inspect import plan_text

    df = spark.range(100).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    cut = df.checkpoint()  # reliable checkpoint into the session's folder
    assert cut.count() == 7
    plan = plan_text(cut, "simple")
    assert "ExistingRDD" in plan and "HashAggregate" not in plan


def test_batch_jobs_need_no_checkpoint_folder(spark, monkeypatch):
    """A cluster session is made without one; asking for it names what to set."""
    import pytest

    import sessionscope.session as session

    class Master:
        master = "spark://cluster:7077"
        getCheckpointDir = staticmethod(lambda: None)
        setLogLevel = staticmethod(lambda level: None)

    class Fake:
        sparkContext = Master()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    class Builder:
        appName = master = config = lambda self, *a: self
        getOrCreate = lambda self: Fake()

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    assert session.build_session("spark://cluster:7077").sparkContext.master.startswith("spark")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake())
