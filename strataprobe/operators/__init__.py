"""DataFrame-to-DataFrame operators over the canonical schemas."""
