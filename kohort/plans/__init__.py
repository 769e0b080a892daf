"""Fixtures, registered queries and their SQL oracles, end-to-end jobs."""
