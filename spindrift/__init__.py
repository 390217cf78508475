"""Spindrift: text and vector analytics as plain functions on Spark DataFrames."""
