"""Time-series backtest and analytics jobs on Spark DataFrames."""
