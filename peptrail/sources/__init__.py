"""Readers: FASTA records, tab-separated tables, membership lines."""
