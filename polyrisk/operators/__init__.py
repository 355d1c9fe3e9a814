"""Relational operators over exposures, episodes, patterns and per-code tables."""
