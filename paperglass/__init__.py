"""A document-extraction analytics engine on Spark."""
