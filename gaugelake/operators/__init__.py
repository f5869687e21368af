"""Operators: functions from DataFrames to DataFrames, over all sensors at once."""
