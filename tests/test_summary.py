import math

import pytest

from sparkodds.operators import summary

EPISODES = "game_key string, max_net_arb double, bottleneck_liquidity double, duration_s double"


@pytest.mark.parametrize("measure", [summary.rates, summary.total_value, summary.persistent_summary])
def test_per_game_without_any_game(spark, measure):
    row = measure(spark.createDataFrame([], EPISODES)).first().asDict()
    per_game = {n: v for n, v in row.items() if n.endswith("per_game")}
    assert per_game and all(math.isnan(v) for v in per_game.values())
    assert not any(v for n, v in row.items() if n not in per_game)


@pytest.mark.parametrize("measure", [summary.rates, summary.total_value, summary.persistent_summary])
def test_per_game_of_two_games(spark, measure):
    rows = [("a", 0.5, 4.0, 2.0), ("a", 0.5, 8.0, 2.0), ("b", 0.0, 8.0, 2.0), ("b", 0.25, 8.0, 2.0)]
    row = measure(spark.createDataFrame(rows, EPISODES)).first().asDict()
    expected = {"gross_per_game": 2.0, "net_per_game": 1.5, "value_per_game": 4.0}
    per_game = {n: v for n, v in row.items() if n.endswith("per_game")}
    assert per_game == {n: expected[n] for n in per_game}
