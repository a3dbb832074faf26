"""Data-quality and compliance checks for payment records, as Spark jobs."""
