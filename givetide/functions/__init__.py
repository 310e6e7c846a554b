"""Column-level helpers: calendar arithmetic, case-blind text tests, ordered rules."""
