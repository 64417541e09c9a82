"""Code-intelligence and review analytics as Spark DataFrame operators."""
