"""Inputs and outputs: FASTA text, synthetic keys, result tables."""
