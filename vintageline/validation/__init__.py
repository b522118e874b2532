"""Discrimination, calibration, stability, bootstrap, monotonicity and leakage checks."""
