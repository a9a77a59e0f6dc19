"""Nested documents over keyed change-logs, on Spark DataFrames."""
