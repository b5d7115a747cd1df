"""Trajectory analytics as Spark plans: DataFrame in, DataFrame out."""
