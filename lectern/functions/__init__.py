"""Column expressions; all stay on the JVM side unless their docstring says otherwise."""
