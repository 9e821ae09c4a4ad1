"""Composed flows over the operators."""
