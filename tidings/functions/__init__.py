"""Column expressions shared by the operators. Everything here runs inside the JVM except ``html``."""
