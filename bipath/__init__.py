"""Interaction-network analytics on Spark: two-hop counts, network statistics, recommenders."""
