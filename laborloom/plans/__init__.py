"""laborloom plans."""
