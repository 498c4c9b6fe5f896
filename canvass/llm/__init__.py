"""Training-data operators on Spark DataFrames.

Nothing outside this package imports it; it imports nothing of the survey engine.
"""
