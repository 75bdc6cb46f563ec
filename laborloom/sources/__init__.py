"""laborloom sources."""
