"""Package audit, detector scoring and evaluation analytics as Spark plans."""
