"""Fixed dimensions and scalar column functions."""
