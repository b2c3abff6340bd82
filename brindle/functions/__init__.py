"""Column helpers: scalar, text, date and vector functions. All stay in the JVM (no Python per row)."""
