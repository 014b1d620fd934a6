"""Operators: functions from DataFrames to DataFrames. Times come in as arguments; nothing asks the clock."""
