"""Interval time-series operators on Spark DataFrames.

Every operator takes and returns a DataFrame; ``region`` (the series key) is a
grouping column, so all series move through one plan.
"""
