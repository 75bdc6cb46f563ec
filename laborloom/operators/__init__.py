"""laborloom operators."""
