"""sources of the document-extraction engine."""
