"""Whole runs put together from the operators, and the adapters that turn plain tables into their inputs."""
