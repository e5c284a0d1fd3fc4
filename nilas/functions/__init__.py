"""Column expressions: Student t, geometry, calendars, formatting."""
