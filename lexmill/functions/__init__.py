"""Column functions: JVM-side expressions without Python in the hot path."""
