"""Whole jobs composed of operators: batch, speed-plus-batch, stream, validated, domain products."""
