"""Trajectory-to-graph analytics and corpus preparation on Spark."""
