"""Column functions on text and numbers; all run in the JVM."""
