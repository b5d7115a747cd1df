"""Relational operators on trajectories: DataFrame in, DataFrame out."""
