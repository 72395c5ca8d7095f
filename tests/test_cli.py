"""The job entry point writes results through the DataFrame writer."""

from sessionscope.__main__ import main
from tests.conftest import DATA_SMALL


def test_list(capsys):
    assert main(["list"]) == 0
    assert "bounce_rate_by_landing_page" in capsys.readouterr().out.split()


def test_run_writes_parquet(spark, tmp_path):
    out = str(tmp_path / "out")
    assert main(["run", "weekly_sources", "--data", DATA_SMALL, "--out", out]) == 0
    got = spark.read.parquet(out)
    assert got.columns == ["yrwk", "week_start_date", "total_nonbrand_sessions", "gsearch_sessions", "bsearch_sessions"]
    assert got.count() > 0


def test_run_on_saved_tables(spark, tmp_path):
    from sessionscope.sources.tables import ShopTables

    ShopTables.from_events(spark, DATA_SMALL).save_as_tables("cli_shop", buckets=4, mode="overwrite")
    out = str(tmp_path / "out_tables")
    assert main(["run", "funnel_counts", "--tables", "cli_shop", "--out", out]) == 0
    via_tables = spark.read.parquet(out).collect()
    direct = main(["run", "funnel_counts", "--data", DATA_SMALL, "--out", str(tmp_path / "out_events")])
    assert direct == 0
    assert via_tables == spark.read.parquet(str(tmp_path / "out_events")).collect()


def test_the_input_must_be_named(capsys):
    import pytest

    with pytest.raises(SystemExit):
        main(["run", "weekly_sources", "--out", "/tmp/never"])
    assert "--data" in capsys.readouterr().err
