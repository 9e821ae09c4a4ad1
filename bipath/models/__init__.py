"""Recommenders on the two-hop counts."""
