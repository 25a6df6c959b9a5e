"""operators of the document-extraction engine."""
