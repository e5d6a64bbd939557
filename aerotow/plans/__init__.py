"""Composite jobs (trajectory features, tabular features, model and blend)."""
