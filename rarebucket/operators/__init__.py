"""Sketch construction, estimation and comparison."""
