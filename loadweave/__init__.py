"""Hourly and daily load forecasting as Spark jobs: DataFrames in, DataFrames out."""
