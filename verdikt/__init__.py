"""Spark operators for evaluating automated judges over agent trajectories."""
