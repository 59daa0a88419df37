"""Column-to-column expressions (timestamps, excerpts, classifiers)."""
