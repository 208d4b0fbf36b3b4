"""Quantitative-research analytics on PySpark: bars, features, labels, events, IC, backtests."""
