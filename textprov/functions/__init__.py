"""Column expressions: everything here takes and returns Spark columns and stays inside the JVM."""
