"""Named end-to-end queries assembled from operators."""
