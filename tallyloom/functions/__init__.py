"""Column expressions: aggregates, calendar, text policies, authored expressions."""
