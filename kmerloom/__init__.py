"""kmerloom: Spark DataFrame operators for long, error-prone sequencing reads."""
