"""Readers, writers, model storage and the mapping from the benchmark tables."""
