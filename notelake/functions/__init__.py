"""Column expressions; everything here stays on the JVM unless its docstring says otherwise."""
