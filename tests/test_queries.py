import pytest

from tickloom.sources.samples import SAMPLES

NAMES = ["p1_found", "p1_bars", "p1_logs", "p2_found", "p2_values", "p3_found", "p3_rolling", "p4_impossible", "p5_found", "p5_grid", "tick_ema", "series_bars", "series_ticks", "adx", "drawdown_duration", "hurst_exponent", "bs_call", "bond_convexity", "composite_score", "is_engulfing", "resample_ohlc", "asof_join", "with_returns", "backtest_equity", "backtest_stats", "stream_ohlc", "min_variance_check", "min_variance_portfolio", "max_sharpe_portfolio", "efficient_frontier", "monte_carlo_moments", "am_call", "am_put", "asof_join_by", "stream_ema", "max_drawdown", "calmar_ratio", "ema_window", "rsi_window", *(f"source_{n}" for n in SAMPLES), "sql_rsi", "sql_keltner_upper", "sql_ema_window", "sql_resample_ohlc", "sql_backtest_stats"]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(agrees, name):
    assert agrees(name)


def test_contract():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
