"""Readers, table maintenance and the views that stand for the input tables."""
