"""Price-catalog analytics expressed as Spark DataFrame programs."""
