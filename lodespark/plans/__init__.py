"""End-to-end jobs, fixture views and the query catalogue."""
