"""Where files and texts come from."""
