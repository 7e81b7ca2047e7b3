"""marlpit: implicit-feedback recommendation analytics as Spark DataFrame plans."""
