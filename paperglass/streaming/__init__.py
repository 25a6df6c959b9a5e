"""streaming of the document-extraction engine."""
