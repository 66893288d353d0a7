"""Distributed strategies shared by the operators: order positions, exact quantiles, samples, pair search."""
