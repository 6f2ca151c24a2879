"""Scalar functions: randomness, planning formulas, statistics."""
