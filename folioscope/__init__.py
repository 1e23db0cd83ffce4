"""Evidence-first document analytics on Spark."""
