"""Quantitative-finance analytics on Spark: indicators, pricing, backtests and data preparation."""
