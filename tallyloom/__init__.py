"""A semantic metrics engine on Spark."""
