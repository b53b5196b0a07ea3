"""Indoor network analytics expressed as Spark DataFrame plans."""
