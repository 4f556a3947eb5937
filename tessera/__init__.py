"""Evidence-bound change analytics on Spark."""
