"""Learning-platform analytics expressed as Spark DataFrame plans."""
