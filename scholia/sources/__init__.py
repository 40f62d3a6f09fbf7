"""Sources: driver tables, derived views, files."""
