"""Column-to-column functions; all stay in the JVM unless their name says otherwise."""
