"""Column builders: each takes columns and returns a column, all evaluated inside the JVM."""
