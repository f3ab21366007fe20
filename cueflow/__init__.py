"""Timed-text and interval dataflow expressed as Spark DataFrames."""
