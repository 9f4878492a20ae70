"""The calibration job: built, gated while it is written, stored."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkodds.operators import quality, snapshots
from sparkodds.plans import calibration
from sparkodds.plans import fixtures as fx
from sparkodds.sources import sinks


def test_tables_that_fail_replace_nothing(spark, tmp_path):
    t, path = fx.Tables(spark, "/root/testdata/sf0.001"), str(tmp_path)
    trades, markets = fx.trades(t), fx.markets(t)
    built = calibration.build(
        markets, trades, fx.event_map(t), fx.games(t), fx.plays(t), fx.win_probability(t), fx.weather(t), fx.WINDOW_HOURS, fx.BIN_HOURS
    )
    universe = snapshots.universe(markets)
    with pytest.raises(quality.QualityError, match="one_sided"):
        calibration.write(built, trades, universe, path, None)
    assert not any(tmp_path.iterdir())
    both = built.pre.groupBy("game_pk").agg(F.countDistinct("side").alias("n")).filter("n = 2")
    good = replace(built, pre=built.pre.join(both, "game_pk", "left_semi"))
    stored = calibration.write(good, trades, universe, path, None)
    n = stored.pre.count()
    assert n == 2 * both.count() > 0
    assert sinks.table(spark, f"{path}/mlb_calib_build_info").first()["n_pre_snapshots"] == n
    with pytest.raises(quality.QualityError, match=f"pre_p_y: {n}"):
        calibration.write(replace(good, pre=stored.pre.withColumn("y", F.lit(2))), trades, universe, path, None)
    assert len(sinks.versions(spark, f"{path}/mlb_calib_pre_snapshots")) == 1
