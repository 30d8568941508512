"""Name-addressed generators of labelled time series."""
