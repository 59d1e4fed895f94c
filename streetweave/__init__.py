"""Street-level building evidence as Spark DataFrame operators."""
