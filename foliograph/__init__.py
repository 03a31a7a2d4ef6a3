"""foliograph: scholarly-library analytics expressed as Spark DataFrame plans."""
