"""Operators on spectra and peaks."""
