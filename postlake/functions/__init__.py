"""Column expressions; all run inside the JVM unless a docstring says otherwise."""
