"""Inputs, queries and oracle SQL on the generated tables."""
