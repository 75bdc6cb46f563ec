"""laborloom functions."""
