"""Bandloom: spectra analytics as Spark plans."""
