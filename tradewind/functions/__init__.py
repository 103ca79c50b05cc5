"""Column helpers: exact money and rounding, number formats, decision prose."""
