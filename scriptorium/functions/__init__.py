"""Column functions: text, vectors and full-text analysis, all evaluated in the JVM."""
