"""Reference tables and scalar functions as Column expressions."""
