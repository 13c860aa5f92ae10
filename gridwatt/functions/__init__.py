"""Column-level building blocks: time, calendar, names, geography, measures."""
