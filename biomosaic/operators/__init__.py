"""Operators: functions from DataFrames to one DataFrame, never running a job."""
