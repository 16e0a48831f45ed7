"""Column expressions: missing-value rules, text, dates and axis ticks."""
