"""Peptide carriage analytics on PySpark."""
