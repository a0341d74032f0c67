"""Column functions: each takes and returns ``Column`` and stays on the JVM side."""
