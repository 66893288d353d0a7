"""Profiling and exploration of Spark tables of any size: functions from DataFrame to DataFrame."""
