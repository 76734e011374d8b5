"""Profiling, feature engineering, modelling and prediction analysis on Spark DataFrames."""

__version__ = "0.1.0"
