"""The query suite and its SQL."""
