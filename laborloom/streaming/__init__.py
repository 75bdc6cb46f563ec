"""laborloom streaming."""
