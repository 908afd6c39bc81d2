"""Spectral tables on Spark: nested spectra as DataFrames, numeric encodings as columns."""
