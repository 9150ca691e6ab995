"""Column expressions: take Columns, return Columns, run inside the JVM."""
